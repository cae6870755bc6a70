"""Aggregate measures: regression metrics, intensities, balanced means, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import quantiles


def regression(y: str, p: str) -> dict[str, Column]:
    """All from sums, so partial aggregates combine before the shuffle."""
    e, n = F.col(p) - F.col(y), F.count(F.lit(1))
    sse, mse = F.sum(e * e), F.avg(e * e)
    return {
        "n": n, "mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(e)), "bias": F.avg(e),
        "mape": F.avg(F.abs(e) / F.nullif(F.abs(y), F.lit(0.0))),
        "smape": F.avg(2 * F.abs(e) / F.nullif(F.abs(y) + F.abs(p), F.lit(0.0))),
        "r2": 1 - sse / F.nullif(F.var_pop(y) * n, F.lit(0.0)),
        "nrmse": F.sqrt(mse) / F.nullif(F.max(y) - F.min(y), F.lit(0.0)),
    }


def by_metrics(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*group).agg(*[v.alias(k) for k, v in regression(y, p).items()])


def balanced_mean(df: DataFrame, group: list[str], entity: str, value: str) -> DataFrame:
    """The mean of the entities' means, and the pooled mean."""
    each = df.groupBy(*group, entity).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return each.groupBy(*group).agg(F.count("*").alias("entities"), F.avg("m").alias("balanced_mean"), (F.sum("s") / F.sum("n")).alias("pooled_mean"))


def scopes(df: DataFrame, first: str, second: str, measures: list[Column]) -> DataFrame:
    """All four grouping sets of two columns in one pass, missing ones as 'All'."""
    level = F.grouping_id(first, second).cast("long").alias("level")
    named = [F.when(F.grouping(x) == 1, F.lit("All")).otherwise(F.col(x)).alias(x) for x in (first, second)]
    out = df.cube(first, second).agg(level, *[n.alias(f"__{i}") for i, n in enumerate(named)], *measures)
    return out.drop(first, second).withColumnsRenamed({"__0": first, "__1": second})


def intensity(df: DataFrame, entity: list[str], consumed: str, capacity: str, work: str, factor: float) -> DataFrame:
    """factor * consumption over capacity * work, the capacity being the entity's median."""
    a = df.groupBy(*entity).agg(F.sum(consumed).alias("consumed"), F.sum(work).alias("work"))
    a = a.join(quantiles(df, entity, capacity, [0.5]).select(*entity, F.col("q0").alias("capacity")), entity, "left")
    return a.withColumn("intensity", factor * F.col("consumed") / F.nullif(F.col("capacity") * F.col("work"), F.lit(0.0)))


def within_bands(df: DataFrame, group: list[str], entity: str, value: str, bands: list[float]) -> DataFrame:
    """For each band the shares of values above it, below minus it and within, pooled."""
    parts = []
    for i, b in enumerate(bands):
        v = F.col(value)
        parts += [F.avg(F.when(v > b, 1.0).otherwise(0.0)).alias(f"u{i}"), F.avg(F.when(v < -b, 1.0).otherwise(0.0)).alias(f"d{i}"), F.avg(F.when(F.abs(v) <= b, 1.0).otherwise(0.0)).alias(f"z{i}")]
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"u{i}").alias("above"), F.col(f"d{i}").alias("below"), F.col(f"z{i}").alias("near")) for i, b in enumerate(bands)]))
    names = [f"{x}{i}" for i in range(len(bands)) for x in "udz"]
    balanced = df.groupBy(*group, entity).agg(*parts).groupBy(*group).agg(*[F.avg(n).alias(n) for n in names])
    return balanced.select(*group, each.alias("e")).select(*group, "e.band", "e.above", "e.below", "e.near")
