"""Counterfactual scenarios: support, fixed time, fixed distance by whole intervals, decomposition, grid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An interval count this near below a whole number is taken for it, in minutes.
EPS = 1e-10


def with_levels(df: DataFrame, levels: list[float], name: str) -> DataFrame:
    """A row for each level of a scenario, made within the row."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(x)) for x in levels])))


def supported(df: DataFrame, train: DataFrame, group: str, value: str, scenario: Column) -> DataFrame:
    """supported: whether the scenario's value is within what the group's training rows have."""
    range_ = train.groupBy(group).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    out = df.join(range_, group, "left")
    return out.withColumn("supported", F.coalesce(scenario.between(F.col("__low"), F.col("__high")), F.lit(False))).drop("__low", "__high")


def intervals(df: DataFrame, minutes: str, length: float = 10.0) -> DataFrame:
    """Whole intervals and one exact rest: interval_no from 1, interval_minutes."""
    n = F.floor((F.col(minutes) + EPS) / length)
    rest = F.col(minutes) - n * length
    more = F.when(rest > EPS, 1).otherwise(0)
    count = (n + more).cast("int")
    rows = df.filter(F.col(minutes) > EPS).select("*", F.explode(F.sequence(F.lit(1), count)).alias("interval_no"))
    return rows.withColumn("interval_minutes", F.when((F.col("interval_no") == count) & (more == 1), rest).otherwise(F.lit(length)))


def perturbed(df: DataFrame, changes: list[tuple[str, str, float, float]]) -> DataFrame:
    """A copy of each row for each change: (name, column, factor, added)."""
    names = F.explode(F.array(*[F.lit(n) for n, *_ in changes]))
    out = df.withColumn("perturbation", names)
    for column in dict.fromkeys(x[1] for x in changes):
        value = F.col(column)
        for n, k, factor, added in changes:
            if k == column:
                value = F.when(F.col("perturbation") == n, F.col(column) * factor + added).otherwise(value)
        out = out.withColumn(column, value)
    return out


def best_by(df: DataFrame, group: list[str], low: str, tie_high: str, keep: list[str]) -> DataFrame:
    """The row with the least `low`, of those with the most `tie_high`: one aggregate, no window."""
    best = F.min_by(F.struct(*keep), F.struct(F.col(low), -F.col(tie_high))).alias("b")
    return df.groupBy(*group).agg(best).select(*group, *[f"b.{k}" for k in keep])


def rate_and_time_effects(before: Column, after: Column, time_ratio: Column) -> dict[str, Column]:
    """The ratio of totals as the product of rate and time ratios, with logs that add up."""
    rate = after / F.nullif(before, F.lit(0.0))
    total = rate * time_ratio
    return {"rate_ratio": rate, "time_ratio": time_ratio, "total_ratio": total, "log_rate": F.log(rate), "log_time": F.log(time_ratio), "log_total": F.log(total)}


def elasticity(before: Column, after: Column, ratio: Column) -> Column:
    return F.log(after / before) / F.log(ratio)
