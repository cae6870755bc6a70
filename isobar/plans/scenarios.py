"""Queries on scenarios, validation designs and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenarios, splits, statistics
from .base import TELEMETRY, r, rounded, table, telemetry

LEVELS = [5.0, 10.0, 15.0]


def _voyages(spark, sf):
    """lineitem as voyages: speed, distance, minutes, and a rate of fuel in closed form."""
    x = table(spark, sf, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("kind"), (8 + F.col("l_quantity") / 5).alias("speed"),
        (F.col("l_extendedprice") / 2000).alias("distance"), F.col("l_tax").alias("wave"),
    ).withColumns({"minutes": F.col("distance") / F.col("speed") * 60, "rate": _rate(F.col("speed"), F.col("wave"))})


def _rate(speed, wave):
    return 0.04 + 1e-4 * speed * speed * speed + 0.004 * wave


def _slower(spark, sf):
    v = scenarios.with_levels(_voyages(spark, sf), LEVELS, "level")
    return v.withColumn("ratio", 1 - F.col("level") / 100).withColumn("slow", F.col("speed") * F.col("ratio")).withColumn("slow_rate", _rate(F.col("slow"), F.col("wave")))


def support_mask(spark, sf):
    train = _voyages(spark, sf).filter("l_orderkey % 5 > 0 AND speed >= 9.5")
    s = scenarios.supported(_slower(spark, sf).filter("l_orderkey % 5 = 0"), train, "kind", "speed", F.col("slow"))
    return s.groupBy("kind", "level").agg(F.count("*").alias("n"), F.sum(F.col("supported").cast("long")).alias("supported"), r(100 * F.avg(F.col("supported").cast("double"))).alias("retained_pct"))


def fixed_time(spark, sf):
    s = _slower(spark, sf).groupBy("kind", "level").agg(F.sum("rate").alias("a"), F.sum("slow_rate").alias("b"), F.avg(scenarios.elasticity(F.col("rate"), F.col("slow_rate"), F.col("ratio"))).alias("e"))
    return s.select("kind", "level", r("a", 4).alias("before"), r("b", 4).alias("after"), r(100 * (F.col("b") / F.col("a") - 1)).alias("change_pct"), r("e").alias("elasticity"))


def interval_expand(spark, sf):
    v = _voyages(spark, sf).withColumn("eighths", F.floor(F.col("minutes") * 8) / 8)
    i = scenarios.intervals(v, "eighths")
    return i.groupBy("kind").agg(F.count("*").alias("intervals"), r(F.sum("interval_minutes"), 3).alias("minutes"), F.max("interval_no").cast("bigint").alias("most"), r(F.sum(F.col("rate") * F.col("interval_minutes") / 10), 4).alias("fuel"))


def fuel_time_decomposition(spark, sf):
    s = _slower(spark, sf).groupBy("kind", "level").agg(F.sum(F.col("rate") * F.col("minutes")).alias("f0"), F.sum(F.col("slow_rate") * F.col("minutes") / F.col("ratio")).alias("f1"), F.sum("minutes").alias("t0"), F.sum(F.col("minutes") / F.col("ratio")).alias("t1"))
    e = scenarios.rate_and_time_effects(F.col("f0") / F.col("t0"), F.col("f1") / F.col("t1"), F.col("t1") / F.col("t0"))
    return s.select("kind", "level", *[r(v).alias(k) for k, v in e.items()])


def perturbations(spark, sf):
    p = scenarios.perturbed(_voyages(spark, sf).select("kind", "speed", "wave"), [("base", "speed", 1.0, 0.0), ("speed", "speed", 1.05, 0.0), ("wave", "wave", 1.1, 0.0), ("shift", "wave", 1.0, 1.0)])
    return p.groupBy("kind", "perturbation").agg(r(F.avg(_rate(F.col("speed"), F.col("wave")))).alias("mean_rate"))


def grid_search_best(spark, sf):
    v = scenarios.with_levels(scenarios.with_levels(_voyages(spark, sf), [0.0, 5.0, 10.0], "cut"), [-1.0, 0.0, 1.0], "trim")
    speed = F.col("speed") * (1 - F.col("cut") / 100)
    g = v.groupBy("kind", "cut", "trim").agg(r(F.avg(_rate(speed, F.col("wave")) * (1 + F.col("trim") * F.col("trim") / 100))).alias("cost"), F.sum((speed > 10).cast("long")).alias("kept"))
    return scenarios.best_by(g, ["kind"], "cost", "kept", ["cut", "trim", "cost", "kept"])


def chrono_split(spark, sf):
    s = splits.chronological(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"])
    return s.groupBy("event_type", "split").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("ts").alias("last_ts"))


def temporal_cut(spark, sf):
    s = splits.temporal_cut(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return s.groupBy("user_id", "split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def expanding_folds(spark, sf):
    s = splits.expanding_folds(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], 4, 0.5)
    return s.groupBy("event_type", F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def decile_strata(spark, sf):
    s = splits.quantile_strata(table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["l_returnflag"], "l_extendedprice", "id", 10)
    return s.groupBy("l_returnflag", "stratum").agg(F.count("*").alias("n"), r(F.min("l_extendedprice"), 2).alias("low"), r(F.max("l_extendedprice"), 2).alias("high"))


def stratified_split(spark, sf):
    s = splits.stratified(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", 0.8, "s1")
    return s.groupBy("o_orderpriority", "split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


def hashed_sample(spark, sf):
    return splits.hashed_sample(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, "s2")


def balanced_folds(spark, sf):
    return splits.balanced_folds(table(spark, sf, "events"), ["event_type"], "user_id", 5)


def sample_weights(spark, sf):
    w = splits.balanced_weights(table(spark, sf, "orders"), ["o_custkey"])
    return w.groupBy("o_custkey").agg(F.count("*").alias("n"), r(F.max("weight")).alias("weight"))


def nearest_quantile(spark, sf):
    return splits.nearest_to_quantiles(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", [0.1, 0.5, 0.9])


def pair_halves(spark, sf):
    """First and second hour halves of each user's hour, side by side."""
    e = table(spark, sf, "events").withColumns({"hour": F.date_trunc("HOUR", "ts").cast("timestamp_ntz"), "half": F.when(F.minute("ts") < 30, "a").otherwise("b")})
    p = e.groupBy("user_id", "hour").pivot("half", ["a", "b"]).agg(F.avg("value")).filter("a IS NOT NULL AND b IS NOT NULL")
    return p.select("user_id", "hour", r("a").alias("first_half"), r("b").alias("second_half"))


def _clusters(spark, sf, n: int | None = None):
    """Suppliers as clusters; with n, all suppliers in as many groups."""
    d = F.col("rate") - 0.3
    number = F.col("l_suppkey")
    return _voyages(spark, sf).groupBy((number % n if n else number).alias("c")).agg(F.sum(d * d).alias("sse"), F.count("*").cast("double").alias("n"), F.sum(F.abs(d)).alias("sae"), r(F.avg(d)).alias("diff"))


def signflip_exact(spark, sf):
    s = statistics.sign_flip(_clusters(spark, sf, 12).select("c", "diff"), "c", "diff", 12)
    return s.select(r("observed_mean", 5).alias("observed_mean"), r("p_value").alias("p_value"))


def hashed_bootstrap(spark, sf):
    k = _clusters(spark, sf).select("c", r("sse", 4).alias("sse"), r("sae", 4).alias("sae"), "n")
    b = statistics.cluster_bootstrap(k, "c", ["sse", "sae", "n"], 400, F.sqrt(F.col("sse") / F.col("n")) - F.col("sae") / F.col("n"))
    return b.agg(F.count("*").alias("draws"), r(F.avg("stat")).alias("mean"), r(F.percentile("stat", 0.025)).alias("low"), r(F.percentile("stat", 0.975)).alias("high"))


def two_sample(spark, sf):
    d = statistics.two_sample(table(spark, sf, "events"), "event_type", "click", "view", "value")
    return d.select(r("ks").alias("ks"), r("wasserstein").alias("wasserstein"))


def mean_difference(spark, sf):
    return statistics.mean_difference(table(spark, sf, "events"), "event_type", "click", "view", "value").select(r("smd").alias("smd"))


def hist_overlap(spark, sf):
    return statistics.overlap(table(spark, sf, "events"), "event_type", "click", "view", "value", 0.0, 200.0, 40).select(r("overlap").alias("overlap"))


def spearman(spark, sf):
    return statistics.spearman(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", r("rho").alias("rho"))


def serial_residuals(spark, sf):
    e = table(spark, sf, "events").withColumn("e", F.col("value") - 50)
    return statistics.serial(e, ["event_type"], ["ts", "event_id"], "e", 3).select("event_type", "n", *[r(k).alias(k) for k in ("durbin_watson", "acf1", "acf2", "acf3")])


def ols_moments(spark, sf):
    return statistics.line_fit(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", "n", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"), r("r2").alias("r2"), r("f_stat", 2).alias("f_stat"))


def breusch_pagan(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("e", (F.col("l_extendedprice") - 1000 * F.col("l_quantity")) / 10000)
    return statistics.breusch_pagan(x, ["l_returnflag"], "l_quantity", "e").select("l_returnflag", r("lm", 4).alias("lm"))


def bin_reversals(spark, sf):
    b = table(spark, sf, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_quantity") / 2).cast("long").alias("bin")).agg(r(F.avg("l_discount")).alias("m"))
    return statistics.reversals(b, ["l_returnflag"], "bin", "m").select("l_returnflag", "steps", r("reversal_share").alias("reversal_share"))


def binned_means(spark, sf):
    s = telemetry(spark, sf).withColumn("bin", F.least(F.floor(F.col("value") / 10), F.lit(15)).cast("long"))
    return s.groupBy("bin").agg(F.count("*").alias("n"), r(F.avg("angle"), 4).alias("mean_angle"))


QUERIES = {f.__name__: f for f in (
    support_mask, fixed_time, interval_expand, fuel_time_decomposition, perturbations, grid_search_best, chrono_split, temporal_cut, expanding_folds,
    decile_strata, stratified_split, hashed_sample, balanced_folds, sample_weights, nearest_quantile, pair_halves, signflip_exact, hashed_bootstrap,
    two_sample, mean_difference, hist_overlap, spearman, serial_residuals, ols_moments, breusch_pagan, bin_reversals, binned_means,
)}

R = rounded
RATE = "(0.04::DOUBLE + 1e-4 * {s} * {s} * {s} + 0.004::DOUBLE * wave)"
VOYAGES = f"""v0 AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS kind, 8 + l_quantity / 5 AS speed, l_extendedprice / 2000 AS distance, l_tax AS wave FROM lineitem),
  v AS (SELECT *, distance / speed * 60 AS minutes, {RATE.format(s='speed')} AS rate FROM v0)"""
SLOWER = f"""{VOYAGES}, z0 AS (SELECT *, 1 - level / 100 AS ratio, speed * (1 - level / 100) AS slow FROM v, (SELECT unnest([5.0::DOUBLE, 10, 15]) AS level)), z AS (SELECT *, {RATE.format(s='slow')} AS slow_rate FROM z0)"""
CLUSTERS = lambda c: f"k AS (SELECT {c} AS c, sum((rate - 0.3::DOUBLE) ** 2) AS sse, count(*)::DOUBLE AS n, sum(abs(rate - 0.3::DOUBLE)) AS sae, {R('avg(rate - 0.3::DOUBLE)')} AS diff FROM v GROUP BY 1)"
PLACED = "p AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY {k}) AS total FROM events)"

SQL = {
    "support_mask": f"""WITH {SLOWER}, b AS (SELECT kind, min(speed) AS lo, max(speed) AS hi FROM v WHERE l_orderkey % 5 > 0 AND speed >= 9.5 GROUP BY 1)
      SELECT kind, level, count(*) AS n, sum((slow BETWEEN lo AND hi)::INT)::BIGINT AS supported, {R('100 * avg((slow BETWEEN lo AND hi)::INT)')} AS retained_pct FROM z JOIN b USING (kind) WHERE l_orderkey % 5 = 0 GROUP BY 1, 2""",
    "fixed_time": f"WITH {SLOWER} SELECT kind, level, {R('sum(rate)', 4)} AS before, {R('sum(slow_rate)', 4)} AS after, {R('100 * (sum(slow_rate) / sum(rate) - 1)')} AS change_pct, {R('avg(ln(slow_rate / rate) / ln(ratio))')} AS elasticity FROM z GROUP BY 1, 2",
    "interval_expand": f"""WITH {VOYAGES}, a AS (SELECT *, floor(minutes * 8) / 8 AS t FROM v), b AS (SELECT *, floor((t + 1e-10) / 10) AS w, t - floor((t + 1e-10) / 10) * 10 AS rest FROM a WHERE t > 1e-10),
      c AS (SELECT *, (w + (rest > 1e-10)::INT)::BIGINT AS total FROM b), d AS (SELECT *, unnest(range(1, total + 1)) AS i FROM c), e AS (SELECT *, CASE WHEN i = total AND rest > 1e-10 THEN rest ELSE 10.0::DOUBLE END AS m FROM d)
      SELECT kind, count(*) AS intervals, {R('sum(m)', 3)} AS minutes, max(i) AS most, {R('sum(rate * m / 10)', 4)} AS fuel FROM e GROUP BY 1""",
    "fuel_time_decomposition": f"""WITH {SLOWER}, a AS (SELECT kind, level, sum(rate * minutes) AS f0, sum(slow_rate * minutes / ratio) AS f1, sum(minutes) AS t0, sum(minutes / ratio) AS t1 FROM z GROUP BY 1, 2)
      SELECT kind, level, {R('(f1 / t1) / (f0 / t0)')} AS rate_ratio, {R('t1 / t0')} AS time_ratio, {R('f1 / f0')} AS total_ratio, {R('ln((f1 / t1) / (f0 / t0))')} AS log_rate, {R('ln(t1 / t0)')} AS log_time, {R('ln(f1 / f0)')} AS log_total FROM a""",
    "perturbations": f"""WITH {VOYAGES}, q AS (SELECT kind, u AS perturbation, CASE WHEN u = 'speed' THEN speed * 1.05::DOUBLE ELSE speed END AS s, CASE WHEN u = 'wave' THEN wave * 1.1::DOUBLE WHEN u = 'shift' THEN wave + 1 ELSE wave END AS wave
      FROM v, (SELECT unnest(['base', 'speed', 'wave', 'shift']) AS u)) SELECT kind, perturbation, {R('avg(' + RATE.format(s='s') + ')')} AS mean_rate FROM q GROUP BY 1, 2""",
    "grid_search_best": f"""WITH {VOYAGES}, q AS (SELECT *, speed * (1 - cut / 100) AS s FROM v, (SELECT unnest([0.0::DOUBLE, 5, 10]) AS cut), (SELECT unnest([-1.0::DOUBLE, 0, 1]) AS trim)),
      g AS (SELECT kind, cut, trim, {R('avg(' + RATE.format(s='s') + ' * (1 + trim * trim / 100))')} AS cost, sum((s > 10)::INT)::BIGINT AS kept FROM q GROUP BY 1, 2, 3)
      SELECT kind, cut, trim, cost, kept FROM g QUALIFY row_number() OVER (PARTITION BY kind ORDER BY cost, kept DESC) = 1""",
    "chrono_split": f"""WITH {PLACED.format(k='event_type')} SELECT event_type, CASE WHEN place / total::DOUBLE <= 0.7::DOUBLE THEN 'train' WHEN place / total::DOUBLE <= 0.7::DOUBLE + 0.15::DOUBLE THEN 'valid' ELSE 'test' END AS split, count(*) AS n, min(event_id) AS first_id, max(ts) AS last_ts FROM p GROUP BY 1, 2""",
    "temporal_cut": f"WITH {PLACED.format(k='user_id')} SELECT user_id, CASE WHEN place <= greatest(1, least(total - 1, floor(total * 0.8::DOUBLE))) THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM p GROUP BY 1, 2",
    "expanding_folds": f"""WITH {PLACED.format(k='event_type')} SELECT event_type, (CASE WHEN place > floor(total * 0.5::DOUBLE) AND place <= floor(total * 0.625::DOUBLE) THEN 1 WHEN place > floor(total * 0.625::DOUBLE) AND place <= floor(total * 0.75::DOUBLE) THEN 2
      WHEN place > floor(total * 0.75::DOUBLE) AND place <= floor(total * 0.875::DOUBLE) THEN 3 WHEN place > floor(total * 0.875::DOUBLE) THEN 4 ELSE 0 END)::BIGINT AS fold, count(*) AS n, sum(event_id)::BIGINT AS ids FROM p GROUP BY 1, 2""",
    "decile_strata": f"WITH a AS (SELECT *, ntile(10) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS stratum FROM lineitem) SELECT l_returnflag, stratum, count(*) AS n, {R('min(l_extendedprice)', 2)} AS low, {R('max(l_extendedprice)', 2)} AS high FROM a GROUP BY 1, 2",
    "stratified_split": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s1' || o_orderkey), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
      SELECT o_orderpriority, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM a GROUP BY 1, 2""",
    "hashed_sample": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('s2' || o_orderkey), o_orderkey LIMIT 500",
    "sample_weights": f"SELECT o_custkey, count(*) AS n, {R('(SELECT count(*) FROM orders)::DOUBLE / ((SELECT count(DISTINCT o_custkey) FROM orders) * count(*))')} AS weight FROM orders GROUP BY 1",
    "nearest_quantile": """WITH q AS (SELECT o_orderpriority, unnest([0.1::DOUBLE, 0.5, 0.9]) AS quantile, unnest([quantile_cont(o_totalprice, 0.1), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.9)]) AS v FROM orders GROUP BY 1)
      SELECT o_orderpriority, quantile, first(o_orderkey ORDER BY abs(o_totalprice - v), o_orderkey) AS o_orderkey FROM orders JOIN q USING (o_orderpriority) GROUP BY 1, 2""",
    "pair_halves": f"""WITH a AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(value) FILTER (WHERE minute(ts) < 30) AS a, avg(value) FILTER (WHERE minute(ts) >= 30) AS b FROM events GROUP BY user_id, date_trunc('hour', ts))
      SELECT user_id, hour, {R('a')} AS first_half, {R('b')} AS second_half FROM a WHERE a IS NOT NULL AND b IS NOT NULL""",
    "signflip_exact": f"""WITH {VOYAGES}, {CLUSTERS("l_suppkey % 12")}, m AS (SELECT range AS mask FROM range(4096)), s AS (SELECT mask, sum(diff * CASE WHEN (mask >> c) & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0 END) AS total FROM m, k GROUP BY 1)
      SELECT {R('(SELECT total FROM s WHERE mask = 0) / 12', 5)} AS observed_mean, {R('avg((abs(total) >= abs((SELECT total FROM s WHERE mask = 0)) - 1e-9)::INT)')} AS p_value FROM s""",
    "hashed_bootstrap": f"""WITH {VOYAGES}, {CLUSTERS("l_suppkey")}, d AS (SELECT a.range AS draw, floor((('0x' || substr(md5(a.range || '|' || b.range), 1, 13))::BIGINT)::DOUBLE / 4503599627370496::DOUBLE * (SELECT count(*) FROM k))::BIGINT AS c FROM range(400) a, range((SELECT count(*) FROM k)) b),
      f AS (SELECT draw, sqrt(sum({R('sse', 4)}) / sum(n)) - sum({R('sae', 4)}) / sum(n) AS stat FROM d JOIN k USING (c) GROUP BY 1)
      SELECT count(*) AS draws, {R('avg(stat)')} AS mean, {R('quantile_cont(stat, 0.025)')} AS low, {R('quantile_cont(stat, 0.975)')} AS high FROM f""",
    "two_sample": f"""WITH a AS (SELECT value, count(*) FILTER (WHERE event_type = 'click') AS x, count(*) FILTER (WHERE event_type = 'view') AS y FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
      b AS (SELECT value, lead(value) OVER (ORDER BY value) - value AS step, abs(sum(x) OVER (ORDER BY value)::DOUBLE / (SELECT sum(x) FROM a) - sum(y) OVER (ORDER BY value)::DOUBLE / (SELECT sum(y) FROM a)) AS d FROM a)
      SELECT {R('max(d)')} AS ks, {R('sum(d * step)')} AS wasserstein FROM b""",
    "mean_difference": f"""SELECT {R("(avg(value) FILTER (WHERE event_type = 'click') - avg(value) FILTER (WHERE event_type = 'view')) / sqrt((var_samp(value) FILTER (WHERE event_type = 'click') + var_samp(value) FILTER (WHERE event_type = 'view')) / 2)")} AS smd FROM events""",
    "hist_overlap": f"""WITH a AS (SELECT least(greatest(floor(value / 200 * 40), 0), 39) AS b, count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS x, count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS y FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
      SELECT {R('sum(least(x / (SELECT sum(x) FROM a), y / (SELECT sum(y) FROM a)))')} AS overlap FROM a""",
    "spearman": f"""WITH a AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS x,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem) SELECT l_returnflag, {R('corr(x, y)')} AS rho FROM a GROUP BY 1""",
    "serial_residuals": f"""WITH a AS (SELECT event_type, value - 50 AS e, lag(value - 50, 1) OVER w AS a, lag(value - 50, 2) OVER w AS b, lag(value - 50, 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
      SELECT event_type, count(*) AS n, {R('sum((e - a) ** 2) / sum(e ** 2)')} AS durbin_watson, {R('sum(e * a) / sum(e ** 2)')} AS acf1, {R('sum(e * b) / sum(e ** 2)')} AS acf2, {R('sum(e * c) / sum(e ** 2)')} AS acf3 FROM a GROUP BY 1""",
    "ols_moments": f"""WITH a AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, regr_r2(l_extendedprice, l_quantity) AS q FROM lineitem GROUP BY 1)
      SELECT l_returnflag, n, {R('s', 4)} AS slope, {R('i', 3)} AS intercept, {R('q')} AS r2, {R('q / (1 - q) * (n - 2)', 2)} AS f_stat FROM a""",
    "breusch_pagan": f"SELECT l_returnflag, {R('count(*) * regr_r2(((l_extendedprice - 1000 * l_quantity) / 10000) ** 2, l_quantity)', 4)} AS lm FROM lineitem GROUP BY 1",
    "bin_reversals": f"""WITH a AS (SELECT l_returnflag, floor(l_quantity / 2) AS b, {R('avg(l_discount)')} AS m FROM lineitem GROUP BY 1, 2), d AS (SELECT l_returnflag, lead(m) OVER (PARTITION BY l_returnflag ORDER BY b) - m AS d FROM a)
      SELECT l_returnflag, count(d) AS steps, {R('avg((d < 0)::INT)')} AS reversal_share FROM d GROUP BY 1""",
    "binned_means": f"WITH {TELEMETRY} SELECT least(floor(value / 10), 15)::BIGINT AS bin, count(*) AS n, {R('avg(angle)', 4)} AS mean_angle FROM t GROUP BY 1",
}
