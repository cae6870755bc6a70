"""Validation designs: splits by time, stratum, fold and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series
from .series import running


def placed(df: DataFrame, entity: list[str], order: list[str]) -> DataFrame:
    """Adds the row's number in its entity, from 1, and the entity's rows; an entity may be larger than a task."""
    rows = running(df, entity, order, {"place": F.lit(1)}).withColumn("place", F.col("place").cast("long"))
    sizes = df.groupBy(*[F.col(x).alias(f"__key{i}") for i, x in enumerate(entity)]).agg(F.count("*").alias("entity_rows"))
    same = [F.col(x).eqNullSafe(F.col(f"__key{i}")) for i, x in enumerate(entity)]
    return rows.join(sizes, same).drop(*[f"__key{i}" for i in range(len(entity))])


def chronological(df: DataFrame, entity: list[str], order: list[str], train: float = 0.7, valid: float = 0.15) -> DataFrame:
    share = F.col("place") / F.col("entity_rows")
    split = F.when(share <= train, "train").when(share <= train + valid, "valid").otherwise("test")
    return placed(df, entity, order).withColumn("split", split)


def temporal_cut(df: DataFrame, entity: list[str], order: list[str], train: float = 0.8) -> DataFrame:
    """The first rows train, at least one and at most all but one."""
    cut = F.greatest(F.lit(1), F.least(F.col("entity_rows") - 1, F.floor(F.col("entity_rows") * train)))
    return placed(df, entity, order).withColumn("split", F.when(F.col("place") <= cut, "train").otherwise("test"))


def expanding_folds(df: DataFrame, entity: list[str], order: list[str], folds: int, initial: float) -> DataFrame:
    """fold: the validation fold that a row is in, 0: it only trains. Fold k trains on all before it."""
    edges = [initial + (1 - initial) * k / folds for k in range(folds + 1)]
    at = lambda e: F.floor(F.col("entity_rows") * e)
    fold = F.lit(0)
    for k in range(folds, 0, -1):
        fold = F.when((F.col("place") > at(edges[k - 1])) & (F.col("place") <= at(edges[k])), k).otherwise(fold)
    return placed(df, entity, order).withColumn("fold", fold)


def quantile_strata(df: DataFrame, group: list[str], value: str, tie: str, count: int, name: str = "stratum") -> DataFrame:
    """As many strata of equal rows in each group, the first ones a row larger where they don't divide."""
    small, more = F.floor(F.col("entity_rows") / count), F.col("entity_rows") % count
    large = more * (small + 1)  # rows in the larger strata
    at = F.when(F.col("place") <= large, F.floor((F.col("place") - 1) / (small + 1)) + 1).otherwise(more + F.floor((F.col("place") - large - 1) / F.greatest(small, F.lit(1))) + 1)
    return placed(df, group, [value, tie]).withColumn(name, at.cast("long")).drop("place", "entity_rows")


def stratified(df: DataFrame, strata: list[str], row_id: str, train: float, seed: str) -> DataFrame:
    """The rows of least hash in each stratum train: the same rows whatever the partitions."""
    h = F.md5(F.concat(F.lit(seed), F.col(row_id).cast("string")))
    hashed = df.withColumns({"__h": h, "__first": F.conv(F.substring(h, 1, 12), 16, 10).cast("double")})
    split = F.when(F.col("place") <= F.floor(F.col("entity_rows") * train), "train").otherwise("test")
    return placed(hashed, strata, ["__first", "__h", row_id]).withColumn("split", split).drop("__h", "__first", "place", "entity_rows")


def hashed_sample(df: DataFrame, row_id: str, size: int, seed: str) -> DataFrame:
    """A repeatable sample without replacement of `size` rows."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(row_id).cast("string"))), row_id).limit(size)


def balanced_folds(df: DataFrame, group: list[str], entity: str, folds: int) -> DataFrame:
    """(group, entity, fold): the largest entity first to the fold with the fewest rows. A row an entity reaches the driver."""
    sizes = df.groupBy(*group, entity).count().collect()
    load: dict[tuple, list[int]] = {}
    out = []
    for r in sorted(sizes, key=lambda r: (*[str(r[g]) for g in group], -r["count"], str(r[entity]))):
        held = load.setdefault(tuple(r[g] for g in group), [0] * folds)
        k = min(range(folds), key=lambda i: (held[i], i))
        held[k] += r["count"]
        out.append((*[r[g] for g in group], r[entity], k))
    fields = [df.schema[g] for g in [*group, entity]]
    from pyspark.sql.types import IntegerType, StructField, StructType

    return df.sparkSession.createDataFrame(out, StructType([*fields, StructField("fold", IntegerType())]))


def balanced_weights(df: DataFrame, entity: list[str]) -> DataFrame:
    """Weights under which each entity counts the same and the mean weight is 1."""
    sizes = df.groupBy(*entity).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__rows"), F.count("*").alias("__entities"))
    joined = df.join(sizes, entity).join(F.broadcast(total))
    return joined.withColumn("weight", F.col("__rows") / (F.col("__entities") * F.col("__n"))).drop("__n", "__rows", "__entities")


def nearest_to_quantiles(df: DataFrame, group: list[str], value: str, row_id: str, quantiles: list[float]) -> DataFrame:
    """The row of each group nearest to each quantile of value."""
    found = series.quantiles(df, group, value, quantiles)
    at = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"q{i}").alias("at")) for i, q in enumerate(quantiles)]))
    each = found.select(*group, at.alias("e")).select(*group, "e.quantile", "e.at")
    near = F.min_by(row_id, F.struct(F.abs(F.col(value) - F.col("at")), F.col(row_id))).alias(row_id)
    return df.join(each, group).groupBy(*group, "quantile").agg(near)
