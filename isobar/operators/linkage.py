"""Record linkage, validated joins, overlays and table differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables


def kth_match(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): the k-th row of a key on the left with the k-th of the same key on the right."""
    def occurrence(df: DataFrame, row: str) -> DataFrame:
        there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        return df.filter(there).select(*keys, row, F.row_number().over(Window.partitionBy(*keys).orderBy(row)).alias("__k"))

    return occurrence(left, left_id).join(occurrence(right, right_id), [*keys, "__k"]).select(left_id, right_id)


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) for keys that are there once on either side."""
    once = lambda df, row: df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(row).alias(row)).filter("__n = 1").drop("__n")
    return once(left, left_id).join(once(right, right_id), keys).select(left_id, right_id)


def tiered(left: DataFrame, right: DataFrame, tiers: list[tuple[str, list[str], str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, tier): each tier matches what the tiers before left over. tiers: name, keys, "kth" or "unique"."""
    found: list[DataFrame] = []
    for name, keys, how in tiers:
        pairs = (kth_match if how == "kth" else unique_match)(left, right, keys, left_id, right_id).withColumn("tier", F.lit(name))
        pairs = tables.written(pairs, "tier")  # each tier is found once, though those after it and the result use it
        found.append(pairs)
        left, right = left.join(pairs, left_id, "left_anti"), right.join(pairs, right_id, "left_anti")
    return reduce(DataFrame.unionByName, found)


def outer_with_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A full join with side: both, left_only or right_only."""
    both = left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), keys, "full")
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return both.withColumn("side", side).drop("__l", "__r")


def overlay(base: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """base with the columns' values from patch where it has the key, and overlaid."""
    new = patch.select(*keys, *[F.col(x).alias(f"__{x}") for x in columns], F.lit(True).alias("__hit"))
    out = base.join(new, keys, "left").withColumn("overlaid", F.coalesce("__hit", F.lit(False)))
    return out.withColumns({x: F.when(F.col("overlaid"), F.col(f"__{x}")).otherwise(F.col(x)) for x in columns}).drop("__hit", *[f"__{x}" for x in columns])


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], absolute: float, relative: float) -> DataFrame:
    """One row for each value column: keys in both, only left, only right, and values that differ beyond the tolerances or in nullness."""
    renamed = lambda df, s: df.select(*keys, *[F.col(v).alias(f"{s}_{v}") for v in values])
    both = outer_with_side(renamed(left, "l"), renamed(right, "r"), keys)
    shared = F.col("side") == "both"
    counts = [F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(s) for s in ("both", "left_only", "right_only")]
    differ = []
    for v in values:
        a, b = F.col(f"l_{v}"), F.col(f"r_{v}")
        far = F.coalesce(F.abs(a - b) > absolute + relative * F.abs(b), a.isNull() != b.isNull())
        differ.append(F.sum(F.when(shared & far, 1).otherwise(0)).alias(f"d_{v}"))
    one = both.agg(*counts, *differ)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"d_{v}").alias("differing")) for v in values]))
    return one.select("both", "left_only", "right_only", each.alias("e")).select("e.variable", "both", "left_only", "right_only", "e.differing")


def proves_one_to_one(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """One row: pairs, distinct ids of either side, and whether all three are equal."""
    one = pairs.agg(F.count("*").alias("pairs"), F.countDistinct(left_id).alias("left_ids"), F.countDistinct(right_id).alias("right_ids"))
    return one.withColumn("one_to_one", (F.col("pairs") == F.col("left_ids")) & (F.col("pairs") == F.col("right_ids")))


def merged(left: DataFrame, right: DataFrame, keys: list[str], how: str, validate: str) -> DataFrame:
    """A join that refuses keys which are there more than once on a side that `validate` (1:1, 1:m or m:1) says is unique."""
    for name, df, side in (("left", left, validate[0]), ("right", right, validate[-1])):
        if side == "1":
            again = df.groupBy(*keys).count().filter("count > 1").head(1)
            if again:
                raise ValueError(f"the {name} side has a key more than once: {tuple(again[0][k] for k in keys)}")
    return left.join(right, keys, how)


def linked_enough(left: DataFrame, pairs: DataFrame, left_id: str, least: float = 0.995) -> DataFrame:
    """pairs, if at least such a share of the left rows is linked; otherwise an error that tells the share."""
    rows, linked = left.count(), pairs.select(left_id).distinct().count()
    if linked < least * rows:
        raise ValueError(f"{linked} of {rows} rows are linked, under {least:.1%}")
    return pairs


def without_entities(df: DataFrame, entity: str, excluded: DataFrame) -> DataFrame:
    """df less the entities of a parameter table; null entities stay."""
    return df.join(excluded.select(F.col(entity)).distinct(), entity, "left_anti")
