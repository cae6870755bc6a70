"""Queries on sinks and steps, routed interpolation, and studies that are made of several operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import grid, ml, quality, scenarios, series, splits
from ..sources import tables
from . import series as plans
from .base import TELEMETRY, r, rounded, table, telemetry
from .standard import SHIPS, _ships


def _folder(spark) -> str:
    return f"{tables.shared_dir(spark)}/programs-{uuid.uuid4().hex}"


def append_sink(spark, sf):
    """Events appended part by part, each checked against the table's schema."""
    path, e = _folder(spark), table(spark, sf, "events").select("event_id", "event_type", "value")
    for k in range(3):
        tables.append_checked(e.filter(F.pmod("event_id", F.lit(3)) == k), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def step_state(spark, sf):
    """A step's table after it was built, taken as it was, and built again for a new version."""
    path, inputs = _folder(spark), [f"{sf}/orders.parquet"]
    build = lambda: table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    runs = [tables.run_step(spark, path, v, inputs, build) for v in ("1", "1", "2")]
    return runs[-1][0]


def text_sinks(spark, sf):
    """Ordered CSV read back by inferred types, and JSON."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"))
    a, b = _folder(spark), _folder(spark)
    tables.write_ordered_csv(o, a, ["o_orderkey"], ";")
    tables.write_json(o, b)
    csv, json = tables.inferred_csv(spark, a, 1.0), spark.read.schema(o.schema).json(b)
    both = csv.select("o_orderpriority", F.lit("csv").alias("sink"), F.col("o_orderkey").cast("bigint"), F.col("price").cast("double")).unionByName(json.withColumn("sink", F.lit("json")))
    return both.groupBy("sink", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"), r(F.sum("price"), 1).alias("total"))


def raw_extract(spark, sf):
    """Raw columns as text and parsed, keyed by the row's number in the source's order."""
    x = table(spark, sf, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(" m")).alias("raw"))
    n = series.running(x, [], ["o_orderkey"], {"source_row": F.lit(1)})
    return n.select(F.col("source_row").cast("bigint").alias("source_row"), "raw", c.parse_number(F.regexp_replace("raw", " m", "")).alias("parsed"))


def routed_interpolation(spark, sf):
    """Points go to the part that has their tile, two fields are interpolated there, and each point gets a status."""
    manifest = spark.range(36).select(
        F.concat(F.lit("p"), F.col("id")).alias("part"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda k: F.concat(k.cast("string"), F.lit(":"), F.col("id").cast("string"))), "|").alias("tile_cells"),
    ).filter("id % 5 > 0")
    routed = grid.routed(plans._points(spark, sf), manifest, "lat", "lon")
    there = routed.filter("part IS NOT NULL")
    first = grid.bilinear(there, plans._grid(spark, False), "event_id", [], "field").withColumnRenamed("field", "a")
    second = grid.bilinear(there, plans._grid(spark, True), "event_id", [], "field", circular=True).withColumnRenamed("field", "b")
    j = routed.join(first, "event_id", "left").join(second, "event_id", "left")
    status = c.first_of([("no_part", F.col("part").isNull()), ("outside_grid", F.col("i").isNull()), ("complete", F.col("a").isNotNull() & F.col("b").isNotNull())], "missing_field")
    return j.groupBy(F.coalesce("part", F.lit("none")).alias("part"), status.alias("status")).agg(F.count("*").alias("n"), r(F.avg("a")).alias("mean_a"))


def pooled_and_own(spark, sf):
    x = _ships(spark, sf).withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("row_id", "kind", "speed", "draught")
    m = ml.pooled_and_own(x.filter("row_id % 5 > 0"), x.filter("row_id % 5 = 0"), "kind", "linear", ["speed"], "draught")
    return m.select("kind", "fit", "n", r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"))


def dependence_2d(spark, sf):
    rate = lambda df: df.withColumn("prediction", 0.04 + 1e-4 * F.col("speed") ** 3 + 0.004 * F.col("wave") * F.col("speed") + 0.01 * F.col("draught"))
    x = _ships(spark, sf).select("speed", "wave", "draught")
    p = ml.partial_dependence_2d(x, "speed", "wave", ([9.0, 12.0, 15.0, 18.0], [0.0, 1.0, 2.0, 3.0]), rate, 50)
    return p.select("speed", "wave", "support", r("mean_prediction").alias("mean_prediction"))


def wave_localisation(spark, sf):
    """The response to a tenth more wave by sector, kind and third of the waves."""
    x = _ships(spark, sf).withColumns({"id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "sector": F.when(F.col("l_linenumber") <= 2, "head").when(F.col("l_linenumber") <= 5, "beam").otherwise("stern")})
    t = splits.quantile_strata(x, ["kind"], "wave", "id", 3, "third")
    p = scenarios.perturbed(t, [("base", "wave", 1.0, 0.0), ("more", "wave", 1.1, 0.0)]).withColumn("y", 1 + F.col("wave") ** 2 / 10)
    mean = lambda k: F.avg(F.when(F.col("perturbation") == k, F.col("y")))
    return p.groupBy("sector", "kind", "third").agg((F.count("*") / 2).cast("long").alias("n"), r(100 * (mean("more") / mean("base") - 1)).alias("change_pct"))


def add_back(spark, sf):
    """Rows that one rule took out and that pass all later ones, put back beside the kept rows."""
    x = _ships(spark, sf)
    rules = [quality.Rule("zero", F.coalesce(F.col("trim") == 0, F.lit(False)) | (F.col("wave") == 0)), quality.Rule("slow", F.col("speed") < 9), quality.Rule("length", ~c.finite("length") | (F.col("length") <= 0))]
    first = quality.judged(x, rules)
    candidates = quality.judged(first.filter("first_failed_rule = 'zero'").drop("first_failed_rule", "review"), rules[1:])
    kept = first.filter("first_failed_rule IS NULL").select("kind", F.lit("kept").alias("scope"))
    back = candidates.select("kind", F.coalesce(F.concat(F.lit("fails_"), F.col("first_failed_rule")), F.lit("added_back")).alias("scope"))
    return kept.unionByName(back).groupBy("kind", "scope").agg(F.count("*").alias("n"))


def design_validation(spark, sf):
    """Locks of a paired design: the same rows on either side, unchanged columns identical, changed ones not, splits apart."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    b = o.withColumn("o_totalprice", F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 1.01).otherwise(1.0))
    j = o.join(b.withColumnsRenamed({"o_custkey": "k2", "o_totalprice": "p2"}), "o_orderkey", "full")
    n, same, changed, rows = j.agg(F.count("*"), F.sum((~F.col("o_custkey").eqNullSafe(F.col("k2"))).cast("long")), F.sum((F.abs(F.col("o_totalprice") - F.col("p2")) > 1e-7 * F.abs("o_totalprice")).cast("long")), F.count("o_custkey")).first()
    return quality.checks(spark, [("paired_rows", n, rows, 0), ("unchanged_column", same, 0, 0), ("changed_rows", changed, n / 3, n / 100)])


def head_and_cross(spark, sf):
    """Components along and across the heading, the speed's cube, and ratios."""
    t = telemetry(spark, sf).select("event_id", "event_type", "value", F.radians(F.col("angle") - F.col("lon")).alias("rel"), (F.col("value") / 10).alias("speed"))
    t = t.withColumns({"head": F.col("value") * F.cos("rel"), "across": F.col("value") * F.sin("rel"), "cube": F.col("speed") ** 3})
    return t.groupBy("event_type").agg(r(F.avg("head"), 5).alias("head"), r(F.avg(F.abs("across")), 5).alias("across"), r(F.avg("cube"), 4).alias("cube"), r(F.avg(c.safe_divide("head", "speed")), 5).alias("head_by_speed"))


def mode_fill(spark, sf):
    """Missing static values from their entity's most frequent one, the smallest of several; conflicts are marked."""
    x = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("static"))
    counts = x.filter("static IS NOT NULL").groupBy("o_custkey", "static").agg(F.count("*").alias("n"))
    best = counts.groupBy("o_custkey").agg(F.min_by("static", F.struct(-F.col("n"), F.col("static"))).alias("mode"), F.count("*").alias("kinds"))
    j = x.join(best, "o_custkey", "left")
    source = c.first_of([("given", F.col("static").isNotNull()), ("mode", F.col("mode").isNotNull())], "missing")
    return j.groupBy(source.alias("source"), F.coalesce(F.col("kinds") > 1, F.lit(False)).alias("conflict"), F.coalesce("static", "mode").alias("value")).agg(F.count("*").alias("n"))


def tile_days(spark, sf):
    """By month the different tiles, days, and pairs of them."""
    t = telemetry(spark, sf).select(F.date_format("ts", "yyyy-MM").alias("month"), c.tile("lat", -90, 10, 18).alias("a"), c.tile("lon", -180, 10, 36).alias("b"), F.to_date("ts").alias("day"))
    pairs = t.distinct()  # what is different is found once, not in sets on one task
    one = lambda *keys: pairs.select("month", *keys).distinct().groupBy("month").agg(F.count("*").alias("_".join(keys)))
    out = one("a", "b").join(one("day"), "month").join(one("a", "b", "day"), "month")
    return out.select("month", F.col("a_b").alias("tiles"), F.col("day").alias("days"), F.col("a_b_day").alias("tile_days"))


def quantile_bins(spark, sf):
    """Bins between quantiles, equal edges taken once, and what they hold."""
    x = _ships(spark, sf).select("kind", "wave", "speed")
    q = series.quantiles(x, ["kind"], "wave", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    edges = F.array_distinct(F.array(*[F.round(f"q{i}", 9) for i in range(6)]))
    j = x.join(q.select("kind", edges.alias("edges")), "kind")
    at = F.greatest(F.size(F.filter("edges", lambda e: e < F.round("wave", 9))) - 1, F.lit(0))
    return j.groupBy("kind", at.cast("int").alias("bin")).agg(F.count("*").alias("n"), r(F.min("wave")).alias("low"), r(F.max("wave")).alias("high"), r(F.avg("speed")).alias("mean_speed"))


def duplicate_key_report(spark, sf):
    """Of two tables' keys: rows, different keys, keys more than once, and rows with them."""
    a = table(spark, sf, "lineitem").select(F.lit("lineitem").alias("side"), F.concat_ws("|", "l_partkey", "l_suppkey").alias("k"))
    b = table(spark, sf, "orders").select(F.lit("orders").alias("side"), F.concat_ws("|", "o_custkey", "o_orderdate").alias("k"))
    k = a.unionByName(b).groupBy("side", "k").agg(F.count("*").alias("n"))
    again = F.when(F.col("n") > 1, F.col("n"))
    return k.groupBy("side").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count(again).alias("repeated"), F.coalesce(F.sum(again), F.lit(0)).alias("repeated_rows"))


def stability_replay(spark, sf):
    """Stability found anew with rows that an earlier rule took out let in: which rows change."""
    t = telemetry(spark, sf)
    run = lambda rows, name: series.stability(rows, ["user_id"], "ts", "event_id", "value", 1440.0, 3, 20.0).select("event_id", F.col("stable").alias(name))
    both = run(t.filter("reading IS NOT NULL"), "before").join(run(t, "after"), "event_id", "full")
    return both.groupBy("before", "after").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (append_sink, step_state, text_sinks, raw_extract, routed_interpolation, pooled_and_own, dependence_2d, wave_localisation, add_back, design_validation, head_and_cross, mode_fill, tile_days, quantile_bins, duplicate_key_report, stability_replay)}

_FIT = """t AS (SELECT * FROM y WHERE id % 5 > 0), p AS (SELECT regr_slope(draught, speed) AS s, regr_intercept(draught, speed) AS i FROM t), o AS (SELECT kind, regr_slope(draught, speed) AS s, regr_intercept(draught, speed) AS i FROM t GROUP BY kind),
e AS (SELECT y.kind, 'pooled' AS fit, draught - (p.i + p.s * speed) AS e FROM y, p WHERE id % 5 = 0 UNION ALL SELECT y.kind, 'own', draught - (o.i + o.s * speed) FROM y JOIN o ON y.kind = o.kind WHERE id % 5 = 0)"""

SQL = {
    "append_sink": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
    "step_state": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "text_sinks": f"""SELECT sink, o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS ids, {rounded("sum(round(o_totalprice, 2))", 1)} AS total FROM orders, (SELECT unnest(['csv', 'json']) AS sink) GROUP BY ALL""",
    "raw_extract": "SELECT row_number() OVER (ORDER BY o_orderkey) AS source_row, o_custkey || ' m' AS raw, o_custkey::DOUBLE AS parsed FROM orders",
    "routed_interpolation": f"""WITH {TELEMETRY}, {plans.CELLS}, {plans.LINEAR_GRID}, q AS (SELECT event_id, floor((lon + 180) / 10)::INT AS c FROM t),
a AS (SELECT event_id, CASE WHEN {plans.WHOLE} THEN sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0) END AS a FROM k LEFT JOIN g USING (i, j) WHERE w > 0 GROUP BY event_id)
SELECT CASE WHEN c % 5 > 0 THEN 'p' || c ELSE 'none' END AS part, CASE WHEN c % 5 = 0 THEN 'no_part' WHEN a.event_id IS NULL THEN 'outside_grid' WHEN a IS NOT NULL THEN 'complete' ELSE 'missing_field' END AS status, count(*) AS n,
  {rounded("avg(CASE WHEN c % 5 > 0 THEN a END)")} AS mean_a FROM q LEFT JOIN a USING (event_id) GROUP BY ALL""",
    "pooled_and_own": f"""WITH {SHIPS}, y AS (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM x), {_FIT} SELECT kind, fit, count(*) AS n, {rounded("sqrt(avg(e * e))", 4)} AS rmse, {rounded("avg(abs(e))", 4)} AS mae FROM e GROUP BY ALL""",
    "dependence_2d": f"""WITH {SHIPS}, a AS (SELECT unnest([9.0::DOUBLE, 12, 15, 18]) AS s), b AS (SELECT unnest([0.0::DOUBLE, 1, 2, 3]) AS w),
m AS (SELECT s, w, count(*) FILTER (WHERE abs(speed - s) <= 1.5 AND abs(wave - w) <= 0.5) AS support, avg(0.04::DOUBLE + 1e-4::DOUBLE * pow(s, 3) + 0.004::DOUBLE * w * s + 0.01::DOUBLE * draught) AS v FROM x, a, b GROUP BY ALL)
SELECT s AS speed, w AS wave, support, {rounded("CASE WHEN support >= 50 THEN v END")} AS mean_prediction FROM m""",
    "wave_localisation": f"""WITH {SHIPS}, t AS (SELECT *, CASE WHEN l_linenumber <= 2 THEN 'head' WHEN l_linenumber <= 5 THEN 'beam' ELSE 'stern' END AS sector, ntile(3) OVER (PARTITION BY kind ORDER BY wave, l_orderkey * 10 + l_linenumber) AS third FROM x)
SELECT sector, kind, third, count(*) AS n, {rounded("100 * (avg(1 + pow(wave * 1.1::DOUBLE, 2) / 10) / avg(1 + pow(wave, 2) / 10) - 1)")} AS change_pct FROM t GROUP BY ALL""",
    "head_and_cross": f"""WITH {TELEMETRY}, h AS (SELECT event_type, value * cos(radians(angle - lon)) AS head, value * sin(radians(angle - lon)) AS across, value / 10 AS speed FROM t)
SELECT event_type, {rounded("avg(head)", 5)} AS head, {rounded("avg(abs(across))", 5)} AS across, {rounded("avg(speed * speed * speed)", 4)} AS cube, {rounded("avg(head / nullif(speed, 0))", 5)} AS head_by_speed FROM h GROUP BY 1""",
    "mode_fill": """WITH x AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS static FROM orders), n AS (SELECT o_custkey, static, count(*) AS n FROM x WHERE static IS NOT NULL GROUP BY ALL),
b AS (SELECT o_custkey, static AS mode, count(*) OVER (PARTITION BY o_custkey) AS kinds FROM n QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, static) = 1)
SELECT CASE WHEN static IS NOT NULL THEN 'given' WHEN mode IS NOT NULL THEN 'mode' ELSE 'missing' END AS source, coalesce(kinds > 1, false) AS conflict, coalesce(static, mode) AS value, count(*) AS n FROM x LEFT JOIN b USING (o_custkey) GROUP BY ALL""",
    "tile_days": f"""WITH {TELEMETRY}, d AS (SELECT DISTINCT strftime(ts, '%Y-%m') AS month, floor((lat + 90) / 10)::INT AS a, floor((lon + 180) / 10)::INT AS b, ts::DATE AS day FROM t)
SELECT month, count(DISTINCT (a, b)) AS tiles, count(DISTINCT day) AS days, count(*) AS tile_days FROM d GROUP BY month""",
    "quantile_bins": f"""WITH {SHIPS}, q AS (SELECT kind, list_distinct(list_transform(quantile_cont(wave, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda e: round(e, 9))) AS edges FROM x GROUP BY kind),
j AS (SELECT x.kind, wave, speed, greatest(len(list_filter(edges, lambda e: e < round(wave, 9))) - 1, 0)::INTEGER AS bin FROM x JOIN q ON x.kind = q.kind)
SELECT kind, bin, count(*) AS n, {rounded("min(wave)")} AS low, {rounded("max(wave)")} AS high, {rounded("avg(speed)")} AS mean_speed FROM j GROUP BY ALL""",
    "duplicate_key_report": """WITH k AS (SELECT 'lineitem' AS side, l_partkey || '|' || l_suppkey AS k FROM lineitem UNION ALL SELECT 'orders', o_custkey || '|' || o_orderdate FROM orders), n AS (SELECT side, k, count(*) AS n FROM k GROUP BY ALL)
SELECT side, sum(n)::BIGINT AS rows, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS repeated_rows FROM n GROUP BY side""",
    "stability_replay": f"""WITH {TELEMETRY}, a AS (SELECT *, CASE WHEN {plans.G} IS NULL OR {plans.G} > 1440 THEN 1 ELSE 0 END AS s FROM t WHERE reading IS NOT NULL {plans.W}), b AS (SELECT *, CASE WHEN {plans.G} IS NULL OR {plans.G} > 1440 THEN 1 ELSE 0 END AS s FROM t {plans.W}),
a2 AS (SELECT *, {plans.RUN} AS k FROM a), b2 AS (SELECT *, {plans.RUN} AS k FROM b),
p AS (SELECT event_id, count(value) OVER v < 3 OR stddev_samp(value) OVER v <= 20 AS before FROM a2 WINDOW v AS (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
q AS (SELECT event_id, count(value) OVER v < 3 OR stddev_samp(value) OVER v <= 20 AS after FROM b2 WINDOW v AS (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT before, after, count(*) AS n FROM p FULL JOIN q USING (event_id) GROUP BY ALL""",
    "add_back": f"""WITH {SHIPS}, f AS (SELECT kind, coalesce(trim = 0, false) OR wave = 0 AS z, speed < 9 AS s, length IS NULL OR length <= 0 AS l FROM x)
SELECT kind, CASE WHEN NOT z THEN 'kept' WHEN s THEN 'fails_slow' WHEN l THEN 'fails_length' ELSE 'added_back' END AS scope, count(*) AS n FROM f WHERE z OR NOT (s OR l) GROUP BY ALL""",
    "design_validation": """WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END AS o_totalprice FROM orders),
j AS (SELECT a.o_custkey AS k1, b.o_custkey AS k2, a.o_totalprice AS p1, b.o_totalprice AS p2 FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
c AS (SELECT count(*)::DOUBLE AS n, count(k1)::DOUBLE AS rows, count(*) FILTER (WHERE k1 IS DISTINCT FROM k2)::DOUBLE AS differing, count(*) FILTER (WHERE abs(p1 - p2) > 1e-7 * abs(p1))::DOUBLE AS changed FROM j)
SELECT 'paired_rows' AS "check", n AS observed, rows AS expected, n = rows AS passed FROM c UNION ALL SELECT 'unchanged_column', differing, 0, differing = 0 FROM c UNION ALL SELECT 'changed_rows', changed, n / 3, abs(changed - n / 3) <= n / 100 FROM c""",
}
