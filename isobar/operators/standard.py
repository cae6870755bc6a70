"""Standardisation: text classes, times in UTC, vectors, interactions, draughts and trims, columns chosen by score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

# The words that name ship types and phases, and the statuses of a trim.
SHIP_TYPES = {"bulk": ("bulk", "散货"), "container": ("container", "集装箱"), "tanker": ("tanker", "oil", "油轮", "化学品")}
PHASES = {
    "cruise": ("cruise", "cruising", "sailing", "巡航"),
    "maneuver": ("maneuver", "manoeuv", "机动"),
    "anchor_berth": ("anchor", "berth", "anchorage", "锚", "靠泊"),
}
TRIM_STATUSES = ("invalid_ship_length", "missing_trim", "normal_le_1pct_length", "high_1_to_2_5pct_retained", "invalid_gt_2_5pct_or_absolute_cap")
#: Times as exports write them, after "T" is a space and "/" is "-"; the offset is added where none is given.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mmXXX", "yyyy-MM-ddXXX")


def text_class(text: Column | str, words: dict[str, tuple[str, ...]], underscored: str = " ") -> Column:
    """The first class one of whose words the text has, in lower case; otherwise the text itself, with _ for each of the characters."""
    plain = F.translate(F.lower(F.trim(text)), underscored, "_" * len(underscored))
    has = lambda names: reduce(lambda a, b: a | b, [F.contains(plain, F.lit(n)) for n in names])
    return F.coalesce(c.first_of([(k, has(names)) for k, names in words.items()]), plain)


def utc_time(text: Column | str, zone: str | None = None) -> Column:
    """A time in UTC without a zone, from text in any of the formats; text without an offset is taken for `zone`'s, or UTC's. Null if it doesn't parse."""
    flat = F.regexp_replace(F.translate(F.trim(text), "/", "-"), "^([0-9-]{10})T", "$1 ")
    given = flat.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$") & (F.length(flat) > 10)
    whole = F.when(given, F.regexp_replace(flat, "Z$", "+00:00")).otherwise(F.concat(flat, F.lit("+00:00")))
    instant = F.coalesce(*[F.try_to_timestamp(whole, F.lit(f)) for f in TIME_FORMATS])
    if zone:
        instant = F.when(given, instant).otherwise(F.to_utc_timestamp(instant, zone))
    seconds = (F.unix_micros(instant).cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def age_years(at: Column | str, since: Column | str) -> Column:
    """Years of 365.25 days."""
    return c.hours_between(since, at) / 24 / 365.25


def unit_vector(s: str, co: str) -> tuple[Column, Column]:
    """Sine and cosine scaled to length 1; null where either is missing or beyond 1.000001, or the length is not over 1e-6 or is over 1.010001."""
    norm = F.sqrt(F.col(s) ** 2 + F.col(co) ** 2)
    usable = c.finite(s) & c.finite(co) & (F.abs(s) <= 1.000001) & (F.abs(co) <= 1.000001) & (norm > 1e-6) & (norm <= 1.010001)
    return F.when(usable, F.col(s) / norm), F.when(usable, F.col(co) / norm)


def interactions(df: DataFrame, products: list[tuple[str, ...]]) -> DataFrame:
    """Adds the product of each tuple's columns, named a_x_b; of one column repeated, a_sq or a_cu."""
    name = lambda p: f"{p[0]}_{('', '', 'sq', 'cu')[len(p)]}" if len(set(p)) == 1 else "_x_".join(p)
    return df.withColumns({name(p): reduce(lambda a, b: a * b, [F.col(x) for x in p]) for p in products})


def ridge_products(base: str, crossed: list[str], pair: tuple[str, str]) -> list[tuple[str, ...]]:
    """The square and cube of base, its products with the crossed columns, and one further pair."""
    return [(base, base), (base, base, base), *[(base, x) for x in crossed], pair]


def draught_ends(df: DataFrame, mean: str, trim: str, design: str) -> DataFrame:
    """Draughts fore and aft from their mean and the trim (aft less fore), the lesser, and its ratio to the design draught."""
    fore, aft = F.col(mean) - F.col(trim) / 2, F.col(mean) + F.col(trim) / 2
    least = F.least(fore, aft)
    return df.withColumns({"fore_draught": fore, "aft_draught": aft, "least_draught": least, "least_design_ratio": c.safe_divide(least, design)})


def trim_checked(df: DataFrame, trim: str, length: str, warning: float = 0.01, hard: float = 0.025, cap: float = 6.0) -> DataFrame:
    """trim_warning_limit, trim_hard_limit, trim_kept (null beyond the hard limit) and trim_status."""
    soft, most = warning * F.col(length), F.least(F.lit(cap), hard * F.col(length))
    bad_length, missing, normal, high, beyond = TRIM_STATUSES
    size = F.abs(trim)
    status = c.first_of(
        [(bad_length, F.col(length).isNull() | (F.col(length) <= 0)), (missing, ~F.coalesce(c.finite(trim), F.lit(False))), (normal, size <= soft), (high, size <= most)], beyond
    )
    return df.withColumns({
        "trim_warning_limit": soft, "trim_hard_limit": most, "trim_status": status,
        "trim_kept": F.when((F.col(length) > 0) & c.finite(trim) & (size <= most), F.col(trim)),
    })


@dataclass(frozen=True)
class NameScore:
    """Words that give a normalised column name a score; where: anywhere, or edge (it begins or ends with one)."""

    category: str
    score: int
    words: tuple[str, ...]
    where: str = "anywhere"


def chosen_column(names: list[str], scores: list[NameScore], excluded: tuple[str, ...] = (), bonus: tuple[str, ...] = (), bonus_score: int = 2) -> tuple[str | None, list[tuple[str, int, str]]]:
    """The column of the highest score, and (column, score, category) of all that score; none where the highest is shared."""
    from ..sources.tables import normal_name

    found = []
    for column in names:
        plain = normal_name(column)
        if any(w in plain for w in excluded):
            continue
        for s in scores:
            if any(plain.startswith(w) or plain.endswith(w) if s.where == "edge" else w in plain for w in s.words):
                extra = bonus_score if bonus and (plain.endswith(bonus[0]) or any(w in plain for w in bonus[1:])) else 0
                found.append((column, s.score + extra, s.category))
                break
    found.sort(key=lambda x: (-x[1], x[0]))
    alone = len(found) == 1 or len(found) > 1 and found[0][1] > found[1][1]
    return (found[0][0] if alone else None), found


def missing_rates(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column, present, rows, missing, missing_share) of each expected column; an absent one is missing in all rows. One pass."""
    there = {x.lower() for x in df.columns}
    counts = [F.count(F.col(x) if x.lower() in there else F.lit(None)).alias(f"n{i}") for i, x in enumerate(expected)]
    one = df.agg(F.count("*").alias("rows"), *counts)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.lit(x.lower() in there).alias("present"), F.col(f"n{i}").alias("n")) for i, x in enumerate(expected)]))
    missing = F.col("rows") - F.col("e.n")
    return one.select("rows", each.alias("e")).select("e.column", "e.present", "rows", missing.alias("missing"), c.safe_divide(missing.cast("double"), F.col("rows").cast("double")).alias("missing_share"))


def range_audit(df: DataFrame, group: list[str], limits: dict[str, tuple[float, float, bool]]) -> DataFrame:
    """By group and variable: rows, finite ones, those in range (low, high, whether low itself is in) and least and most."""
    parts = []
    for i, (v, (low, high, closed)) in enumerate(limits.items()):
        ok = c.finite(v) & ((F.col(v) >= low) if closed else (F.col(v) > low)) & (F.col(v) <= high)
        there = F.when(c.finite(v), F.col(v))
        parts += [F.count(there).alias(f"f{i}"), F.sum(F.coalesce(ok, F.lit(False)).cast("long")).alias(f"i{i}"), F.min(there).alias(f"a{i}"), F.max(there).alias(f"b{i}")]
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), *[F.col(f"{k}{i}").alias(n) for k, n in zip("fiab", ("finite", "in_range", "least", "most"), strict=True)]) for i, v in enumerate(limits)]))
    return df.groupBy(*group).agg(F.count("*").alias("rows"), *parts).select(*group, "rows", each.alias("e")).select(*group, "rows", "e.*")
