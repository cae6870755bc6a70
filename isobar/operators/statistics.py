"""Inference on clusters and distributions. Draws come from md5, so every engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .series import range_parts, running


def hashed_uniform(*parts: Column) -> Column:
    """In [0, 1), from 13 hex digits of an md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cluster_bootstrap(clusters: DataFrame, number: str, sums: list[str], draws: int, statistic: Column, salt: str | None = None) -> DataFrame:
    """(draw, stat): clusters(number 0 to n - 1, sums) drawn n at a time with replacement; statistic is over the drawn sums.

    draws * n rows for n clusters; the rows under the clusters are aggregated once and never resampled. Draws are made from a range
    of numbers, whose size the planner knows: rows exploded out of one row count as small, and would be broadcast.
    """
    spark = clusters.sparkSession
    kept = written(clusters.select(number, *sums), "clusters")
    n = kept.count()
    slots = spark.range(0, draws * n, 1, max(spark.sparkContext.defaultParallelism, draws * n // 1_000_000 + 1))
    slots = slots.select(F.expr(f"id div {max(n, 1)}").alias("draw"), (F.col("id") % max(n, 1)).alias("slot"))
    picked = slots.select("draw", F.floor(hashed_uniform(*([F.lit(salt)] if salt else []), F.col("draw"), F.col("slot")) * n).cast("long").alias(number))
    drawn = picked.join(kept, number).groupBy("draw").agg(*[F.sum(s).alias(s) for s in sums])
    return drawn.select(F.col("draw").cast("long").alias("draw"), statistic.alias("stat"))


def sign_flip(differences: DataFrame, number: str, value: str, n: int) -> DataFrame:
    """The exact two-sided sign-flip test over all 2**n masks of n <= 18 clusters: observed mean, p."""
    spark = differences.sparkSession
    one = differences.agg(F.collect_list(F.struct(number, value)).alias("d"))
    masks = spark.range(1 << n).withColumnRenamed("id", "mask")
    total = F.aggregate("d", F.lit(0.0), lambda s, x: s + x[value] * F.when(F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), x[number].cast("int"))) != 0, -1.0).otherwise(1.0))
    each = masks.join(F.broadcast(one)).select("mask", total.alias("total"))
    seen = each.filter("mask = 0").select(F.abs("total").alias("seen"), F.col("total").alias("own"))
    return each.join(F.broadcast(seen)).agg((F.max("own") / n).alias("observed_mean"), F.avg(F.when(F.abs("total") >= F.col("seen") - 1e-9, 1.0).otherwise(0.0)).alias("p_value"))


def two_sample(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """KS distance and Wasserstein-1 distance of two groups' values, by one merge of their distribution functions."""
    sizes = df.agg(F.sum(F.when(F.col(group) == first, 1).otherwise(0)).alias("na"), F.sum(F.when(F.col(group) == second, 1).otherwise(0)).alias("nb"))
    each = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).groupBy(value).agg(
        F.sum(F.when(F.col(group) == first, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(group) == second, 1).otherwise(0)).alias("b"))
    run = running(each, [], [value], {"ca": F.col("a"), "cb": F.col("b")})
    d = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    step = followed(run, value, "next").join(F.broadcast(sizes))  # one row
    return step.agg(F.max(d).alias("ks"), F.sum(d * (F.col("next") - F.col(value))).alias("wasserstein"))


def followed(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the next larger value, by ranges: null after the last."""
    dealt = range_parts(df, value, "__range")
    least = dealt.groupBy("__range").agg(F.min(value).alias("__least"))
    after = least.select(F.col("__range").alias("__r"), F.lead("__least").over(Window.orderBy("__range")).alias("__after"))  # a row for each range
    ahead = F.lead(value).over(Window.partitionBy("__range").orderBy(value))
    return dealt.withColumn("__ahead", ahead).join(after, F.col("__range") == F.col("__r")).select(*df.columns, F.coalesce("__ahead", "__after").alias(name))


def mean_difference(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """The standardised mean difference."""
    def part(g: str, f) -> Column:
        return f(F.when(F.col(group) == g, F.col(value)))

    spread = F.sqrt((part(first, F.var_samp) + part(second, F.var_samp)) / 2)
    return df.agg(((part(first, F.avg) - part(second, F.avg)) / spread).alias("smd"))


def overlap(df: DataFrame, group: str, first: str, second: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """The common area of two groups' histograms."""
    at = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    counts = df.filter(F.col(group).isin(first, second)).groupBy(at.alias("bin")).agg(
        F.sum(F.when(F.col(group) == first, 1.0).otherwise(0.0)).alias("a"), F.sum(F.when(F.col(group) == second, 1.0).otherwise(0.0)).alias("b"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return counts.join(F.broadcast(total)).agg(F.sum(F.least(F.col("a") / F.col("ta"), F.col("b") / F.col("tb"))).alias("overlap"))


def average_ranks(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds ranks where ties share their mean rank: running counts of different values, joined back."""
    counted = written(df.groupBy(*group, value).agg(F.count("*").alias("__n")), "values")
    ranked = running(counted, group, [value], {"__upto": F.col("__n")})
    rank = (F.col("__upto") - F.col("__n") + 1 + (F.col("__n") - 1) / 2).alias(name)
    keys = [*group, value]
    ranked = ranked.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], rank)
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    return df.join(ranked, same).drop(*[f"__key{i}" for i in range(len(keys))])


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(*group, x, y), group, x, "__x"), group, y, "__y")
    return ranked.groupBy(*group).agg(F.corr("__x", "__y").alias("rho"))


def serial(df: DataFrame, entity: list[str], order: list[str], e: str, lags: int) -> DataFrame:
    """Durbin-Watson and autocorrelations of residuals in their order.

    Rows are numbered by ranges; the row k before is the one with the number less by k, so no entity meets in one task.
    """
    rows = running(df.select(*entity, *[x for x in order if x not in entity], e), entity, order, {"__no": F.lit(1)}).select(*entity, e, "__no")
    square = F.sum(F.col(e) ** 2)
    out = rows.groupBy(*entity).agg(F.count("*").alias("n"), square.alias("__square"))
    paired = [F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("__no") + k).alias("at")) for k in range(1, lags + 1)])).alias("l")]
    earlier = rows.select(*entity, F.col(e).alias("__before"), *paired).select(*entity, "__before", "l.k", F.col("l.at").alias("__no"))
    both = rows.join(earlier, [*entity, "__no"])
    sums = [F.sum(F.when(F.col("k") == 1, (F.col(e) - F.col("__before")) ** 2)).alias("__steps")]
    sums += [F.sum(F.when(F.col("k") == k, F.col(e) * F.col("__before"))).alias(f"__c{k}") for k in range(1, lags + 1)]
    out = out.join(both.groupBy(*entity).agg(*sums), entity, "left")
    part = lambda x: F.col(x) / F.nullif(F.col("__square"), F.lit(0.0))
    return out.select(*entity, "n", part("__steps").alias("durbin_watson"), *[part(f"__c{k}").alias(f"acf{k}") for k in range(1, lags + 1)])


def line_fit(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x from moments, with R squared and the F statistic."""
    a = df.groupBy(*group).agg(F.count("*").alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"))
    return a.withColumn("f_stat", F.col("r2") / F.nullif(1 - F.col("r2"), F.lit(0.0)) * (F.col("n") - 2))


def breusch_pagan(df: DataFrame, group: list[str], x: str, e: str) -> DataFrame:
    """Koenker's statistic: n times R squared of the squared residuals on x."""
    s = df.withColumn("__s", F.col(e) ** 2)
    return s.groupBy(*group).agg((F.count("*") * F.regr_r2(F.col("__s"), F.col(x))).alias("lm"))


def reversals(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Among neighbouring bins the share of steps down."""
    step = df.withColumn("__d", F.lead(value).over(Window.partitionBy(*group).orderBy(order)) - F.col(value))
    return step.groupBy(*group).agg(F.count("__d").alias("steps"), F.avg(F.when(F.col("__d").isNotNull(), F.when(F.col("__d") < 0, 1.0).otherwise(0.0))).alias("reversal_share"))
