"""Rules, bands, robust bounds and audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from .series import quantiles


@dataclass(frozen=True)
class Rule:
    """fails: whether a row breaks the rule (null: it does not). action: delete, or review (the row is kept and marked)."""

    name: str
    fails: Column
    action: str = "delete"


def judged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rows with first_failed_rule (of those that delete) and review (all others that are broken), in one pass."""
    broken = [(r.name, F.coalesce(r.fails, F.lit(False)), r.action) for r in rules]
    return df.withColumns({
        "first_failed_rule": c.first_of([(n, x) for n, x, a in broken if a == "delete"]),
        "review": c.reasons([(n, x) for n, x, a in broken if a == "review"]),
    })


def cascade_audit(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """For each rule, in order, the rows that reach it, those that it removes and those that are left."""
    deleting = [r.name for r in rules if r.action == "delete"]
    found = judged(df, rules).groupBy("first_failed_rule").count()
    order = F.array_position(F.array(*[F.lit(n) for n in deleting]), F.col("rule"))
    steps = df.sparkSession.createDataFrame([(n,) for n in deleting], "rule string")
    removed = steps.join(found, F.col("rule") == F.col("first_failed_rule"), "left").select(order.alias("step"), "rule", F.coalesce("count", F.lit(0)).alias("removed"))
    total = found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    so_far = F.sum("removed").over(Window.orderBy("step"))  # a row for each rule
    return removed.join(F.broadcast(total)).select("step", "rule", (F.col("total") - so_far + F.col("removed")).alias("reached"), "removed", (F.col("total") - so_far).alias("left_over"))


def mad_flags(df: DataFrame, group: list[str], value: str, times: float, least_rows: int) -> DataFrame:
    """Rows with their group's size, median and MAD, and low: under median - times * MAD in a group large enough.

    Both medians are exact and found by ranges of values, so that a group need not fit one task.
    """
    median = lambda rows, v, name: _keyed(quantiles(rows, group, v, [0.5]), group).withColumnRenamed("q0", name).drop("n")
    size = _keyed(df.groupBy(*group).agg(F.count("*").alias("group_rows")), group)
    away = _met(_met(df, size, group), median(df, value, "group_median"), group).withColumn("__away", F.abs(F.col(value) - F.col("group_median")))
    low = (F.col("group_rows") >= least_rows) & (F.col(value) < F.col("group_median") - times * F.col("group_mad"))
    return _met(away, median(away, "__away", "group_mad"), group).drop("__away").withColumn("low", low)


def _keyed(stats: DataFrame, group: list[str]) -> DataFrame:
    return stats.withColumnsRenamed({g: f"__key{i}" for i, g in enumerate(group)})


def _met(df: DataFrame, keyed: DataFrame, group: list[str]) -> DataFrame:
    """df with its groups' statistics; null is a group like others."""
    same = [F.col(g).eqNullSafe(F.col(f"__key{i}")) for i, g in enumerate(group)]
    return df.join(keyed, same, "left").drop(*[f"__key{i}" for i in range(len(group))])


def upper_fences(df: DataFrame, entity: list[str], value: str, q: float, times: float) -> DataFrame:
    """By entity the quantile q and Q3 + times * IQR."""
    p = quantiles(df, entity, value, [0.25, 0.75, q])
    return p.select(*entity, F.col("q2").alias("high_quantile"), (F.col("q1") + times * (F.col("q1") - F.col("q0"))).alias("iqr_fence"))


def threshold_counts(df: DataFrame, group: list[str], value: str, levels: list[float]) -> DataFrame:
    """For each group and level, the rows, those above and their share; the levels are expanded within a row, rows aren't multiplied."""
    above = [F.sum(F.when(F.col(value) > x, 1).otherwise(0)).alias(f"n{i}") for i, x in enumerate(levels)]
    counted = df.groupBy(*group).agg(F.count("*").alias("rows"), *above)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"n{i}").alias("above")) for i, x in enumerate(levels)]))
    return counted.select(*group, "rows", each.alias("e")).select(*group, "rows", "e.level", "e.above", (F.col("e.above") / F.col("rows")).alias("share"))


def profile(df: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """By group and variable: rows, missing share, mean, deviation, median, 5 % and 95 % quantiles."""
    long = df.unpivot(group, names, "variable", "value")
    by = [*group, "variable"]
    q = _keyed(quantiles(long, by, "value", [0.05, 0.5, 0.95]).drop("n"), by)
    one = long.groupBy(*by).agg(
        F.count("*").alias("rows"), (1 - F.count("value") / F.count("*")).alias("missing_share"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    return _met(one, q, by).withColumnsRenamed({"q0": "q05", "q1": "median", "q2": "q95"})


def checks(spark, found: list[tuple[str, float, float, float]]) -> DataFrame:
    """(check, observed, expected, passed) of (name, observed, expected, tolerance)."""
    return spark.createDataFrame([(n, float(o), float(e), abs(o - e) <= t) for n, o, e, t in found], "check string, observed double, expected double, passed boolean")
