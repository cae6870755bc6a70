"""Inference on crossed factors and clusters: interaction tests, contrasts, permutations, detectable effects, density overlap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import cluster_bootstrap, hashed_uniform

# Standard normal quantiles of 0.95 and 0.80.
Z95, Z80 = 1.6448536269514722, 0.8416212335729143


def cells(df: DataFrame, a: str, b: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, n, s, q): rows, sums and sums of squares of the cells of two factors. All tests below start from these."""
    return df.groupBy(*(by or []), a, b).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))


def _contrast(found: list) -> tuple[list, list, np.ndarray]:
    """The levels of both factors, and the rows that give all interactions from cell means in the order (a, b)."""
    la, lb = sorted({r["a"] for r in found}), sorted({r["b"] for r in found})
    at = lambda i, j: i * len(lb) + j
    rows = []
    for i in range(1, len(la)):
        for j in range(1, len(lb)):
            row = np.zeros(len(la) * len(lb))
            row[[at(0, 0), at(i, j)]], row[[at(i, 0), at(0, j)]] = 1, -1
            rows.append(row)
    return la, lb, np.array(rows)


def interaction_f(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """One row: the F statistic of the interaction against both main effects, and its degrees of freedom.

    Normal equations of the additive model are made from the cells, a number of rows that the factors' levels bound.
    """
    found = [r.asDict() for r in cells(df, a, b, y).select(F.col(a).alias("a"), F.col(b).alias("b"), "n", "s", "q").collect()]
    la, lb = sorted({r["a"] for r in found}), sorted({r["b"] for r in found})
    k = 1 + len(la) - 1 + len(lb) - 1
    gram, right = np.zeros((k, k)), np.zeros(k)
    for r in found:
        x = np.zeros(k)
        x[0] = 1
        if r["a"] != la[0]:
            x[la.index(r["a"])] = 1
        if r["b"] != lb[0]:
            x[len(la) - 1 + lb.index(r["b"])] = 1
        gram += r["n"] * np.outer(x, x)
        right += float(r["s"]) * x
    square, n = sum(float(r["q"]) for r in found), sum(r["n"] for r in found)
    reduced = square - right @ np.linalg.lstsq(gram, right, rcond=None)[0]
    full = square - sum(float(r["s"]) ** 2 / r["n"] for r in found)
    num, den = len(found) - k, n - len(found)
    f = ((reduced - full) / num) / (full / den) if num and den > 0 and full > 0 else None
    return df.sparkSession.createDataFrame([(f if f is None else float(f), num, den)], "f_stat double, df_num int, df_den int")


def cluster_robust_f(df: DataFrame, a: str, b: str, y: str, cluster: str) -> DataFrame:
    """One row: the F statistic of all interactions with a sandwich covariance over clusters.

    In the saturated model a cell's estimate is its mean, and a cluster's score for a cell the sum of its residuals there;
    the products of scores are summed over the cluster, so only cells x cells numbers leave it.
    """
    each = cells(df, a, b, y, [cluster]).select(F.col(cluster).alias("g"), F.col(a).alias("a"), F.col(b).alias("b"), "n", "s", "q")
    whole = each.groupBy("a", "b").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"))
    score = each.join(whole, ["a", "b"]).select("g", "a", "b", (F.col("s") - F.col("n") * F.col("cs") / F.col("cn")).alias("e"))
    meat = score.alias("l").join(score.alias("r"), "g").groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b"), F.col("r.a").alias("a2"), F.col("r.b").alias("b2"))
    products = {(r["a"], r["b"], r["a2"], r["b2"]): r["m"] for r in meat.agg(F.sum(F.col("l.e") * F.col("r.e")).alias("m")).collect()}
    found = [r.asDict() for r in whole.collect()]
    clusters = each.select("g").distinct().count()
    la, lb, contrast = _contrast(found)
    keys = [(x, z) for x in la for z in lb]
    size = {(r["a"], r["b"]): (r["cn"], float(r["cs"])) for r in found}
    if len(size) < len(keys) or clusters < 2 or not len(contrast):
        return df.sparkSession.createDataFrame([(None, len(contrast), clusters - 1)], "f_stat double, df_num int, df_den int")
    mean = np.array([size[k][1] / size[k][0] for k in keys])
    bread = np.diag([1 / size[k][0] for k in keys])
    middle = np.array([[products.get((*p, *q), 0.0) for q in keys] for p in keys])
    n = sum(x for x, _ in size.values())
    spread = bread @ middle @ bread * clusters / (clusters - 1) * (n - 1) / (n - len(keys))
    d = contrast @ mean
    f = d @ np.linalg.pinv(contrast @ spread @ contrast.T) @ d / len(contrast)
    return df.sparkSession.createDataFrame([(float(f), len(contrast), clusters - 1)], "f_stat double, df_num int, df_den int")


def independent_contrast(first: DataFrame, second: DataFrame, number: str, sums: list[str], draws: int, statistic: Column) -> DataFrame:
    """(draw, stat): the difference of a statistic over the clusters of two groups, either drawn on its own."""
    a = cluster_bootstrap(first, number, sums, draws, statistic, "a").withColumnRenamed("stat", "stat_a")
    b = cluster_bootstrap(second, number, sums, draws, statistic, "b").withColumnRenamed("stat", "stat_b")
    return a.join(b, "draw").select("draw", (F.col("stat_a") - F.col("stat_b")).alias("stat"))


def interaction_permutation(clusters: DataFrame, number: str, label: str, level: str, draws: int) -> DataFrame:
    """One row: the interaction F of level and label, and the share of draws that reach it, labels being dealt anew to clusters.

    clusters(number from 0, label, level, n, s, q), as many rows of each cluster at all levels. The hashed order of clusters
    within a draw takes the labels in their own order; draw -1 is what was seen.
    """
    one = clusters.select(F.col(number).alias("__c"), F.col(label).alias("__label")).distinct()
    ordered = one.withColumn("__place", F.row_number().over(Window.orderBy("__label", "__c")))  # a row a cluster
    dealt = one.select("__c", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    mixed = dealt.withColumn("__place", F.row_number().over(Window.partitionBy("draw").orderBy(hashed_uniform(F.lit("p"), F.col("draw"), F.col("__c")), "__c")))
    mapped = mixed.join(ordered.select("__place", "__label"), "__place").select("draw", "__c", "__label").unionByName(one.select(F.lit(-1).alias("draw"), "__c", "__label"))
    cell = clusters.join(mapped, F.col(number) == F.col("__c")).groupBy("draw", "__label", level).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    over = lambda *keys: Window.partitionBy("draw", *keys)
    mean = lambda w: F.sum("s").over(w) / F.sum("n").over(w)
    deviation = F.col("s") / F.col("n") - mean(over("__label")) - mean(over(level)) + mean(over())
    parts = cell.withColumn("__d", deviation).groupBy("draw").agg(
        F.sum(F.col("n") * F.col("__d") ** 2).alias("between"), F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).alias("within"), F.sum("n").alias("rows"),
        F.countDistinct("__label").alias("i"), F.countDistinct(level).alias("j"),
    )
    f = parts.select("draw", (F.col("between") / ((F.col("i") - 1) * (F.col("j") - 1)) / (F.col("within") / (F.col("rows") - F.col("i") * F.col("j")))).alias("f"))
    seen = f.filter("draw = -1").select(F.col("f").alias("observed"))
    return f.filter("draw >= 0").join(F.broadcast(seen)).groupBy("observed").agg(((F.sum((F.col("f") >= F.col("observed") - 1e-9).cast("long")) + 1) / (F.count("*") + 1)).alias("p_value"))


def sign_flip_draws(differences: DataFrame, number: str, value: str, draws: int) -> DataFrame:
    """One row: the mean difference and the share of draws of hashed signs whose mean reaches it, one-sided."""
    drawn = differences.select(number, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    sign = F.when(hashed_uniform(F.lit("s"), F.col("draw"), F.col(number)) < 0.5, -1.0).otherwise(1.0)
    means = drawn.groupBy("draw").agg(F.avg(sign * F.col(value)).alias("mean"))
    seen = differences.agg(F.avg(value).alias("observed"))
    return means.join(F.broadcast(seen)).groupBy("observed").agg(((F.sum((F.col("mean") >= F.col("observed") - 1e-12).cast("long")) + 1) / (F.count("*") + 1)).alias("p_value"))


def detectable(df: DataFrame, levels: list[float], size: str, delta: str) -> DataFrame:
    """For each threshold on |size|: rows beyond it, the mean change over its deviation, and the least such effect that a one-sided
    test of 5 % finds with a power of 80 %, in the normal approximation. Levels are counted in one pass."""
    parts = []
    for i, x in enumerate(levels):
        v = F.when(F.abs(size) > x, F.col(delta))
        parts += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.avg((v > 0).cast("double")).alias(f"p{i}")]
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), *[F.col(f"{k}{i}").alias(n) for k, n in zip("nmsp", ("n", "mean", "sd", "positive_share"), strict=True)]) for i, x in enumerate(levels)]))
    out = df.agg(*parts).select(each.alias("e")).select("e.*")
    return out.withColumns({"effect": F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)), "least_detectable": F.when(F.col("n") >= 3, (Z95 + Z80) / F.sqrt("n"))})


def density_overlap(df: DataFrame, group: str, first: str, second: str, value: str, low: float, high: float, points: int, bins: int) -> DataFrame:
    """The common area of two groups' Gaussian kernel densities, with Scott's bandwidths, from counts in fine bins.

    The bins bound the work: each is spread over the points, whatever the number of rows.
    """
    width, step = (high - low) / bins, (high - low) / (points - 1)
    side = F.when(F.col(group) == first, "a").when(F.col(group) == second, "b")
    rows = df.filter(F.col(group).isin(first, second)).withColumn("__side", side)
    band = rows.groupBy("__side").agg(F.count(value).alias("__n"), (F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2))).alias("__h"))
    at = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1))
    binned = rows.filter(F.col(value).isNotNull()).groupBy("__side", (low + (at + 0.5) * width).alias("__x")).agg(F.count("*").alias("__c"))
    spread = binned.join(F.broadcast(band), "__side").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__k"))  # a row a side
    z = (low + F.col("__k") * step - F.col("__x")) / F.col("__h")
    density = spread.groupBy("__k").pivot("__side", ["a", "b"]).agg(F.sum(F.col("__c") * F.exp(-z * z / 2)) / F.first(F.col("__n") * F.col("__h")) / float(np.sqrt(2 * np.pi)))
    return density.agg((F.sum(F.least("a", "b")) * step).alias("overlap"))
