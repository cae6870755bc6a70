"""Column functions; batch and stream share them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Earth's radius in nautical miles, and knots in a metre a second.
NAUTICAL_RADIUS = 3440.065
KNOTS = 1.9438444924406048


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    return col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def complete(*names: str) -> Column:
    """All of the columns are there and finite."""
    return reduce(lambda a, b: a & b, [finite(n) for n in names])


def within(x: Column | str, low: float, high: float) -> Column:
    return F.coalesce(col(x).between(low, high), F.lit(False))


def in_range_or_null(x: Column | str, low: float, high: float) -> Column:
    return F.when(finite(x) & col(x).between(low, high), col(x))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def fused(a: Column, b: Column, more: Column) -> Column:
    """a * b + more of doubles, none null, rounded once. A call by reflection for each row: for small tables."""
    return F.call_function("java_method", F.lit("java.lang.Math"), F.lit("fma"), a.cast("double"), b.cast("double"), more.cast("double")).cast("double")


def parse_number(text: Column | str) -> Column:
    """A number out of text with separators and unit text; null if there is none."""
    digits = F.regexp_replace(col(text), "[^0-9eE+\\-.]", "")
    return F.when(digits.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), digits.try_cast("double"))


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def wrap_360(angle: Column | str) -> Column:
    return F.pmod(col(angle), F.lit(360.0))


def wrap_180(angle: Column | str) -> Column:
    """In [-180, 180), by two remainders as in SQL: one pmod keeps bits that SQL rounds off, and an edge at 45 degrees parts the two."""
    return ((col(angle) + 180.0) % 360.0 + 360.0) % 360.0 - 180.0


def circular_distance(a: Column | str, b: Column | str) -> Column:
    return F.abs(wrap_180(col(a) - col(b)))


def from_sin_cos(s: Column, c: Column) -> Column:
    """Degrees in [0, 360); null where the vector has no direction."""
    return F.when(F.hypot(s, c) >= 1e-12, F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))


def circular_mean(angle: Column | str, weight: Column | str | None = None) -> Column:
    """Aggregate: the mean direction, weighted if a weight is given."""
    w = F.lit(1.0) if weight is None else col(weight)
    r = F.radians(angle)
    return from_sin_cos(F.sum(F.sin(r) * w), F.sum(F.cos(r) * w))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: rows without a value don't weigh."""
    return F.sum(col(value) * col(weight)) / F.nullif(F.sum(F.when(col(value).isNotNull(), col(weight))), F.lit(0.0))


def apparent_speed(own: Column | str, wind: Column | str, relative: Column | str) -> Column:
    """The law of cosines; relative: degrees between own heading and the wind's."""
    inner = col(own) ** 2 + col(wind) ** 2 - 2.0 * col(own) * col(wind) * F.cos(F.radians(relative))
    return F.sqrt(F.greatest(inner, F.lit(0.0)))


def speed_from_uv(u: Column | str, v: Column | str) -> Column:
    return F.hypot(u, v) * KNOTS


def direction_from_uv(u: Column | str, v: Column | str, calm: float = 0.01) -> Column:
    """The direction that it blows from; null in a calm."""
    return F.when(F.hypot(u, v) >= calm, F.pmod(F.degrees(F.atan2(-col(u), -col(v))), F.lit(360.0)))


def haversine(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Nautical miles."""
    a = F.sin(F.radians(col(lat2) - col(lat1)) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(col(lon2) - col(lon1)) / 2) ** 2
    return 2 * NAUTICAL_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def tile(x: Column | str, low: float, step: float, count: int) -> Column:
    return F.least(F.greatest(F.floor((col(x) - low) / step), F.lit(0)), F.lit(count - 1)).cast("int")


def first_of(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all conditions that hold, joined by semicolons."""
    return F.concat_ws(";", *[F.when(condition, name) for name, condition in rules])


def coalesced(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first value that is there, and the name of where it came from."""
    return F.coalesce(*[c for _, c in sources]), first_of([(n, c.isNotNull()) for n, c in sources])


def hours_between(earlier: Column | str, later: Column | str) -> Column:
    return (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) / 3_600_000_000


def minutes_between(earlier: Column | str, later: Column | str) -> Column:
    return (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) / 60_000_000
