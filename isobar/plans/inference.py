"""Queries on inference over crossed factors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference, statistics
from .base import r, rounded, table


def _rows(spark, sf):
    """lineitem at three scenario levels: a change by kind and level, suppliers as clusters."""
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("cluster"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    x = x.withColumn("level", F.explode(F.array(F.lit(5), F.lit(10), F.lit(15))))
    return x.withColumn("y", F.col("q") * 0.1 + F.col("level") * F.when(F.col("kind") == "A", 0.012).otherwise(0.01) * F.col("q") + F.col("d") * 10)


def interaction_f(spark, sf):
    return inference.interaction_f(_rows(spark, sf), "level", "kind", "y").select(r("f_stat", 4).alias("f_stat"), "df_num", "df_den")


def cluster_robust_f(spark, sf):
    x = _rows(spark, sf).filter("level < 15").withColumn("is_a", (F.col("kind") == "A").cast("int"))
    return inference.cluster_robust_f(x, "level", "is_a", "y", "cluster").select(r("f_stat", 4).alias("f_stat"), "df_num", "df_den")


def _clusters(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.groupBy(F.col("l_suppkey").alias("k")).agg(r(F.sum(F.col("l_quantity") * F.col("l_discount")), 4).alias("a"), r(F.sum("l_quantity"), 4).alias("b"), r(F.sum(F.col("l_quantity") * F.col("l_tax")), 4).alias("t"))


def independent_contrast(spark, sf):
    """Odd against even suppliers: the ratio of sums."""
    k = _clusters(spark, sf)
    half = lambda odd: k.filter(F.col("k") % 2 == odd).withColumn("c", F.floor(F.col("k") / 2).cast("long"))
    b = inference.independent_contrast(half(1), half(0), "c", ["a", "b"], 200, F.col("a") / F.col("b"))
    return b.agg(F.count("*").alias("draws"), r(F.avg("stat"), 8).alias("mean"), r(F.min("stat"), 8).alias("least"), r(F.max("stat"), 8).alias("most"))


def paired_delta(spark, sf):
    """Two branches over the same drawn clusters."""
    k = _clusters(spark, sf).withColumn("c", F.col("k"))
    b = statistics.cluster_bootstrap(k, "c", ["a", "t", "b"], 200, F.col("t") / F.col("b") - F.col("a") / F.col("b"))
    return b.agg(F.count("*").alias("draws"), r(F.avg("stat"), 8).alias("mean"), r(F.min("stat"), 8).alias("least"), r(F.max("stat"), 8).alias("most"))


def interaction_permutation(spark, sf):
    x = _rows(spark, sf).groupBy(F.col("cluster").alias("c"), "level").agg(F.count("*").alias("n"), r(F.sum("y"), 4).alias("s"), r(F.sum(F.col("y") * F.col("y")), 4).alias("q"))
    p = inference.interaction_permutation(x.withColumn("label", F.col("c") % 3), "c", "label", "level", 100)
    return p.select(r("observed", 5).alias("observed"), r("p_value").alias("p_value"))


def signflip_draws(spark, sf):
    k = _clusters(spark, sf).select("k", r(F.col("t") / F.col("b") - F.col("a") / F.col("b") * 0.8, 8).alias("d"))
    return inference.sign_flip_draws(k, "k", "d", 300).select(r("observed", 7).alias("observed"), r("p_value").alias("p_value"))


def detectable_effects(spark, sf):
    x = table(spark, sf, "lineitem").select((F.col("l_quantity") - 25).alias("size"), (F.col("l_discount") - F.col("l_tax")).alias("delta"))
    d = inference.detectable(x, [0.0, 5.0, 15.0, 30.0], "size", "delta")
    return d.select("threshold", "n", *[r(k).alias(k) for k in ("mean", "sd", "positive_share", "effect", "least_detectable")])


def kde_overlap(spark, sf):
    return inference.density_overlap(table(spark, sf, "events"), "event_type", "click", "view", "value", 0.0, 400.0, 101, 400).select(r("overlap", 5).alias("overlap"))


QUERIES = {f.__name__: f for f in (interaction_f, cluster_robust_f, independent_contrast, paired_delta, interaction_permutation, signflip_draws, detectable_effects, kde_overlap)}

ROWS = """x AS (SELECT l_returnflag AS kind, l_suppkey AS cluster, level, l_quantity::DOUBLE * 0.1::DOUBLE + level * CASE WHEN l_returnflag = 'A' THEN 0.012::DOUBLE ELSE 0.01::DOUBLE END * l_quantity::DOUBLE + l_discount::DOUBLE * 10 AS y
  FROM lineitem, (SELECT unnest([5, 10, 15]) AS level))"""
CLUSTERS = f"""k AS (SELECT l_suppkey AS k, {rounded("sum(l_quantity::DOUBLE * l_discount::DOUBLE)", 4)} AS a, {rounded("sum(l_quantity::DOUBLE)", 4)} AS b, {rounded("sum(l_quantity::DOUBLE * l_tax::DOUBLE)", 4)} AS t FROM lineitem GROUP BY 1)"""
HASH = lambda *parts: f"(('0x' || substr(md5({chr(32) + '|| chr(124) ||' .join(parts)}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496::DOUBLE"
_DRAWS = lambda salt, table, n: f"SELECT a.range AS draw, floor({HASH(salt + 'a.range', 'b.range')} * (SELECT count(*) FROM {table}))::BIGINT AS c FROM range({n}) a, range((SELECT count(*) FROM {table})) b"
_ENDS = f"count(*) AS draws, {rounded('avg(stat)', 8)} AS mean, {rounded('min(stat)', 8)} AS least, {rounded('max(stat)', 8)} AS most"
_F = """m AS (SELECT {by} n, q - s * s / n AS w, s / n - sum(s) OVER (PARTITION BY {by} lab) / sum(n) OVER (PARTITION BY {by} lab) - sum(s) OVER (PARTITION BY {by} level) / sum(n) OVER (PARTITION BY {by} level) + {all} AS d FROM c)"""

SQL = {
    # every row is at every level, so the interaction's sum of squares is that of the cell means' deviations
    "interaction_f": f"""WITH {ROWS}, c AS (SELECT kind AS lab, level, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM x GROUP BY ALL), {_F.format(by="", all="sum(s) OVER () / sum(n) OVER ()")}
SELECT {rounded("(sum(n * d * d) / 4) / (sum(w) / (sum(n) - 9))", 4)} AS f_stat, 4::INTEGER AS df_num, (sum(n) - 9)::INTEGER AS df_den FROM m""",
    "cluster_robust_f": f"""WITH {ROWS}, z AS (SELECT *, (kind = 'A')::INT AS g FROM x WHERE level < 15), c AS (SELECT level, g, count(*) AS n, avg(y) AS m FROM z GROUP BY ALL),
e AS (SELECT z.cluster, sum(CASE WHEN (z.level = 10) = (z.g = 1) THEN 1 ELSE -1 END * (y - m) / n) AS u FROM z JOIN c ON z.level = c.level AND z.g = c.g GROUP BY 1),
t AS (SELECT (SELECT sum(CASE WHEN (level = 10) = (g = 1) THEN m ELSE -m END) FROM c) AS d, sum(u * u) * count(*) / (count(*) - 1) * ((SELECT count(*) FROM z) - 1) / ((SELECT count(*) FROM z) - 4) AS v, count(*) - 1 AS k FROM e)
SELECT {rounded("d * d / v", 4)} AS f_stat, 1::INTEGER AS df_num, k::INTEGER AS df_den FROM t""",
    "independent_contrast": f"""WITH {CLUSTERS}, o AS (SELECT *, (k // 2)::BIGINT AS c FROM k WHERE k % 2 = 1), e AS (SELECT *, (k // 2)::BIGINT AS c FROM k WHERE k % 2 = 0),
p AS (SELECT draw, sum(a) / sum(b) AS v FROM ({_DRAWS("'a|' || ", "o", 200)}) JOIN o USING (c) GROUP BY 1), q AS (SELECT draw, sum(a) / sum(b) AS v FROM ({_DRAWS("'b|' || ", "e", 200)}) JOIN e USING (c) GROUP BY 1),
f AS (SELECT p.v - q.v AS stat FROM p JOIN q USING (draw)) SELECT {_ENDS} FROM f""",
    "paired_delta": f"""WITH {CLUSTERS}, n AS (SELECT *, k AS c FROM k), f AS (SELECT draw, sum(t) / sum(b) - sum(a) / sum(b) AS stat FROM ({_DRAWS("", "n", 200)}) JOIN n USING (c) GROUP BY 1) SELECT {_ENDS} FROM f""",
    "interaction_permutation": f"""WITH {ROWS}, g AS (SELECT cluster AS c, level, count(*) AS n, {rounded("sum(y)", 4)} AS s, {rounded("sum(y * y)", 4)} AS q FROM x GROUP BY ALL), one AS (SELECT DISTINCT c, c % 3 AS label FROM g),
o AS (SELECT label, row_number() OVER (ORDER BY label, c) AS place FROM one), d AS (SELECT range AS draw, c, row_number() OVER (PARTITION BY range ORDER BY {HASH("'p'", "range", "c")}, c) AS place FROM one, range(100)),
l AS (SELECT draw, c, label AS lab FROM d JOIN o USING (place) UNION ALL SELECT -1, c, label FROM one), c AS (SELECT draw, lab, level, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM g JOIN l USING (c) GROUP BY ALL),
{_F.format(by="draw,", all="sum(s) OVER (PARTITION BY draw) / sum(n) OVER (PARTITION BY draw)")}, f AS (SELECT draw, (sum(n * d * d) / 4) / (sum(w) / (sum(n) - 9)) AS f FROM m GROUP BY draw), z AS (SELECT f AS seen FROM f WHERE draw = -1)
SELECT {rounded("(SELECT seen FROM z)", 5)} AS observed, {rounded("(count(*) FILTER (WHERE f >= (SELECT seen FROM z) - 1e-9) + 1) / (count(*) + 1)::DOUBLE")} AS p_value FROM f WHERE draw >= 0""",
    "signflip_draws": f"""WITH {CLUSTERS}, v AS (SELECT k, {rounded("t / b - a / b * 0.8::DOUBLE", 8)} AS d FROM k), m AS (SELECT range AS draw, avg(CASE WHEN {HASH("'s'", "range", "k")} < 0.5 THEN -d ELSE d END) AS mean FROM v, range(300) GROUP BY 1), o AS (SELECT avg(d) AS seen FROM v)
SELECT {rounded("(SELECT seen FROM o)", 7)} AS observed, {rounded("(count(*) FILTER (WHERE mean >= (SELECT seen FROM o) - 1e-12) + 1) / (count(*) + 1)::DOUBLE")} AS p_value FROM m""",
    "detectable_effects": f"""WITH x AS (SELECT l_quantity::DOUBLE - 25 AS size, l_discount::DOUBLE - l_tax::DOUBLE AS delta FROM lineitem), t AS (SELECT unnest([0.0::DOUBLE, 5.0, 15.0, 30.0]) AS threshold),
g AS (SELECT threshold, count(delta) FILTER (WHERE abs(size) > threshold) AS n, avg(delta) FILTER (WHERE abs(size) > threshold) AS mean, stddev_samp(delta) FILTER (WHERE abs(size) > threshold) AS sd,
  avg((delta > 0)::INT::DOUBLE) FILTER (WHERE abs(size) > threshold) AS positive_share FROM x, t GROUP BY 1)
SELECT threshold, n, {", ".join(f"{rounded(e)} AS {k}" for k, e in (("mean", "mean"), ("sd", "sd"), ("positive_share", "positive_share"), ("effect", "mean / nullif(sd, 0)"), ("least_detectable", "CASE WHEN n >= 3 THEN (1.6448536269514722::DOUBLE + 0.8416212335729143::DOUBLE) / sqrt(n) END")))} FROM g""",
    "kde_overlap": f"""WITH e AS (SELECT event_type AS side, value FROM events WHERE event_type IN ('click', 'view')), h AS (SELECT side, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2::DOUBLE) AS h FROM e GROUP BY 1),
b AS (SELECT side, least(greatest(floor(value), 0), 399) + 0.5::DOUBLE AS x, count(*) AS c FROM e WHERE value IS NOT NULL GROUP BY ALL),
d AS (SELECT range AS k, b.side, sum(c * exp(-pow((range * 4.0::DOUBLE - x) / h, 2) / 2)) / first(n * h) / sqrt(2 * pi()) AS f FROM b JOIN h USING (side), range(101) GROUP BY ALL)
SELECT {rounded("sum(least(u, v)) * 4", 5)} AS overlap FROM (SELECT k, max(f) FILTER (WHERE side = 'click') AS u, max(f) FILTER (WHERE side = 'view') AS v FROM d GROUP BY k)""",
}
