"""Irregular series per entity: sessions, islands, rolling checks, strict resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources.tables import written


def ordered(entity: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*entity).orderBy(*order)


def numbered_runs(df: DataFrame, starts: Column, entity: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of the run, from 1, where `starts` marks a run's first row."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(ordered(entity, order).rowsBetween(Window.unboundedPreceding, 0)))


def gap_sessions(df: DataFrame, entity: list[str], ts: str, tie: str, gap_minutes: float, name: str = "session_no") -> DataFrame:
    before = F.lag(ts).over(ordered(entity, [ts, tie]))
    marked = df.withColumn("gap_minutes", c.minutes_between(before, ts))
    return numbered_runs(marked, F.col("gap_minutes").isNull() | (F.col("gap_minutes") > gap_minutes), entity, [ts, tie], name)


def jump_sessions(df: DataFrame, entity: list[str], ts: str, tie: str, lat: str, lon: str, gap_minutes: float, most_speed: float) -> DataFrame:
    """Sessions that also end where the implied speed, in knots, is more than most_speed."""
    w = ordered(entity, [ts, tie])
    moved = df.withColumns({
        "gap_minutes": c.minutes_between(F.lag(ts).over(w), ts),
        "distance_nm": c.haversine(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon),
    }).withColumn("implied_speed", c.safe_divide("distance_nm", F.col("gap_minutes") / 60))
    starts = F.col("gap_minutes").isNull() | (F.col("gap_minutes") > gap_minutes) | F.coalesce(F.col("implied_speed") > most_speed, F.lit(False))
    return numbered_runs(moved, starts, entity, [ts, tie], "session_no")


def segment_id(entity: Column, number: Column, width: int = 5) -> Column:
    return F.concat(entity.cast("string"), F.lit("_S"), F.lpad(number.cast("string"), width, "0"))


def islands(df: DataFrame, condition: Column, entity: list[str], order: list[str]) -> DataFrame:
    """The rows where condition holds, with the number of their uninterrupted run."""
    w = ordered(entity, order)
    flagged = df.withColumn("__in", condition)
    runs = numbered_runs(flagged, F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False)), entity, order, "island_no")
    return runs.filter("__in").drop("__in")


def stability(df: DataFrame, entity: list[str], ts: str, tie: str, value: str, gap_minutes: float, points: int, most_std: float) -> DataFrame:
    """Blocks without gaps, the deviation of the last points in them, and whether it is small; too few points pass."""
    blocks = gap_sessions(df, entity, ts, tie, gap_minutes, "block_no")
    w = ordered([*entity, "block_no"], [ts, tie]).rowsBetween(-(points - 1), 0)
    out = blocks.withColumns({"rolling_n": F.count(value).over(w), "rolling_std": F.stddev_samp(value).over(w)})
    return out.withColumn("stable", (F.col("rolling_n") < points) | (F.col("rolling_std") <= most_std))


def effective_interval(df: DataFrame, entity: list[str], ts: str, tie: str, given: str | None, nominal: float, most: float) -> DataFrame:
    """interval_minutes and where it is from: the given one if usable, else the time to the next row, else the nominal one."""
    ahead = c.minutes_between(ts, F.lead(ts).over(ordered(entity, [ts, tie])))
    usable = lambda x: F.when((x > 0) & (x <= most), x)
    sources = ([("given", usable(F.col(given)))] if given else []) + [("next", usable(ahead)), ("nominal", F.lit(nominal))]
    value, source = c.coalesced(sources)
    return df.withColumns({"interval_minutes": value, "interval_source": source})


def dedup_states(df: DataFrame, keys: list[str], value: str, angle: str, label: str, flag: str, order: list[str]) -> DataFrame:
    """One row a key: mean value, circular mean angle, first label that is there, worst flag."""
    first = F.min_by(label, F.struct(*order)) if label else F.lit(None)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg(value).alias("value_mean"), c.circular_mean(angle).alias("angle_mean"),
        first.alias("label_first"), F.min(flag).alias("flag_worst"),
    )


def window_states(df: DataFrame, entity: list[str], ts: str, window: str, value: str, angle: str, weight: str, slots: int, least: float, most: float) -> DataFrame:
    """Tumbling windows: weighted means, the integral, coverage, and a status; a window that isn't complete has no target."""
    agg = df.groupBy(*entity, F.window(ts, window).alias("w")).agg(
        F.count("*").alias("slot_count"), F.sum(F.when(F.col(value).isNotNull(), 1).otherwise(0)).alias("valid_count"),
        F.sum(weight).alias("coverage_minutes"), c.weighted_mean(value, weight).alias("value_mean"),
        c.circular_mean(angle, weight).alias("angle_mean"), F.sum(F.col(value) * F.col(weight) / 60).alias("integral"),
    )
    status = c.first_of(
        [
            ("wrong_slot_count", F.col("slot_count") < slots),
            ("invalid_value", F.col("valid_count") < F.col("slot_count")),
            ("coverage", ~F.col("coverage_minutes").between(least, most)),
        ],
        "complete",
    )
    return agg.withColumn("status", status).select(
        *entity, F.col("w.start").alias("window_start"), "slot_count", "coverage_minutes", "value_mean", "angle_mean", "status",
        F.when(F.col("status") == "complete", F.col("integral")).alias("target"), F.col("integral").alias("target_partial"),
    )


def end_aligned_totals(df: DataFrame, entity: list[str], ts: str, window: str, value: str) -> DataFrame:
    """Totals of intervals by the window in which they end; one that ends on an edge belongs to the window before."""
    end = F.col(ts) - F.expr("INTERVAL 1 MICROSECOND")
    return df.groupBy(*entity, F.window(end, window).alias("w")).agg(F.sum(value).alias("total"), F.count(value).alias("parts")).select(
        *entity, F.col("w.start").alias("window_start"), "total", "parts"
    )


def carry_forward(df: DataFrame, entity: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that was there before the row."""
    w = ordered(entity, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def brackets(timeline: DataFrame, targets: DataFrame, entity: list[str], ts: str) -> DataFrame:
    """For each target row the timeline's times at or before and at or after it, by one pass over both, sorted within ranges of time.

    timeline: entity, ts; targets: entity, ts and other columns. No range join, no row pairs.
    """
    others = [x for x in targets.columns if x not in {*entity, ts}]
    both = timeline.select(*entity, ts, F.lit(True).alias("__line")).unionByName(targets.withColumn("__line", F.lit(False)), allowMissingColumns=True)
    both = range_parts(both, ts, "__range")
    at = F.when(F.col("__line"), F.col(ts))
    ends = both.groupBy(*entity, "__range").agg(F.max(at).alias("__last"), F.min(at).alias("__first"))
    by_range = Window.partitionBy(*entity).orderBy("__range")  # a row for each range
    outside = ends.select(
        *[F.col(x).alias(f"__key{i}") for i, x in enumerate(entity)], F.col("__range").alias("__r"),
        F.max("__last").over(by_range.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.min("__first").over(by_range.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    up = Window.partitionBy(*entity, "__range").orderBy(F.col(ts).asc(), F.col("__line").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*entity, "__range").orderBy(F.col(ts).desc(), F.col("__line").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"__low": F.last(at, ignorenulls=True).over(up), "__high": F.last(at, ignorenulls=True).over(down)}).filter("NOT __line")
    same = [F.col("__range") == F.col("__r"), *[F.col(x).eqNullSafe(F.col(f"__key{i}")) for i, x in enumerate(entity)]]
    return found.join(outside, same).select(*entity, ts, *others, F.coalesce("__low", "__before").alias("lower_ts"), F.coalesce("__high", "__after").alias("upper_ts"))


def _place(df: DataFrame, column: str) -> Column:
    """A column as a number, for range bounds."""
    kind = df.schema[column].dataType.simpleString()
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else F.col(column).cast("double")


def range_parts(df: DataFrame, order: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the number of the range that a row's `order` is in: `parts` ranges of about equal rows, nulls in the first.

    Bounds are approximate quantiles, found in a pass of their own; they bear on the ranges' sizes alone. A row finds its range by
    binary search, in plain comparisons: they are compiled, and a join on the number can't lose the column that they are about,
    as it does with a function over an array.
    """
    n = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = _place(df, order)
    bounds = df.agg(F.percentile_approx(at, [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    edges = sorted(set(bounds))

    def number(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("__place") > F.lit(float(edges[middle])), number(middle + 1, high)).otherwise(number(low, middle))

    return df.withColumn("__place", at).withColumn(name, number(0, len(edges))).drop("__place")


def running(df: DataFrame, group: list[str], order: list[str], measures: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds sums of the measures up to and with each row, in the order, by group, without a group's rows meeting in one task.

    Rows are parted by ranges of the first order column; each range is summed alone and starts from the sum of those before.
    """
    dealt = range_parts(df, order[0], "__range", parts).withColumns({f"__{k}": v for k, v in measures.items()})
    sums = dealt.groupBy(*group, "__range").agg(*[F.sum(f"__{k}").alias(f"__in_{k}") for k in measures])
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__in_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in measures])
    within = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"__{k}": F.sum(f"__{k}").over(within) for k in measures})
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = own.join(starts, same)
    return out.select(*df.columns, *[(F.col(f"__{k}") + F.col(f"__before_{k}")).alias(k) for k in measures])


def quantiles(df: DataFrame, group: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact, interpolated quantiles q0, q1 ... of each group's values, nulls aside, and n, the number of values.

    Different values are counted first; counts by ranges tell which range each quantile lies in, and only its values are
    sorted, so neither a group's values nor the different ones among them are held in one task.
    """
    counted = written(df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__n")), "values")
    dealt = range_parts(counted, "__v", "__range")
    cells = dealt.groupBy(*group, "__range").agg(F.sum("__n").alias("__in"))  # a row for each range of a group
    whole, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"n": F.sum("__in").over(whole), "__end": F.sum("__in").over(upto)}).withColumn("__start", F.col("__end") - F.col("__in"))
    ends = [f((F.col("n") - 1) * q) for q in at for f in (F.floor, F.ceil)]
    needed = cells.filter(reduce(lambda a, b: a | b, [(F.col("__start") <= e) & (e < F.col("__end")) for e in ends]))
    needed = needed.select(*[F.col(g).alias(f"__t{i}") for i, g in enumerate(group)], F.col("__range").alias("__r"), "n", "__start")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__t{i}")) for i, g in enumerate(group)], F.col("__range") == F.col("__r"))
    both = dealt.join(needed, same)  # only ranges that a quantile lies in
    within = Window.partitionBy(*group, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__upto", F.col("__start") + F.sum("__n").over(within))
    first = F.col("__upto") - F.col("__n")
    found = []
    for i, q in enumerate(at):
        place = (F.col("n") - 1) * q
        for k, end in (("a", F.floor(place)), ("b", F.ceil(place))):
            found.append(F.max(F.when((first <= end) & (end < F.col("__upto")), F.col("__v"))).alias(f"__{k}{i}"))
    out = both.groupBy(*group, "n").agg(*found)
    mixed = []
    for i, q in enumerate(at):
        a, b, place = F.col(f"__a{i}"), F.col(f"__b{i}"), (F.col("n") - 1) * q
        d = place - F.floor(place)
        mixed.append(F.when(d == 0, a).otherwise(c.fused(a, 1 - d, b * d)))  # to the last bit as in DuckDB: rows at a quantile compare as there
    return written(out.select(*group, "n", *[m.alias(f"q{i}") for i, m in enumerate(mixed)]), "quantiles")  # a row a group
