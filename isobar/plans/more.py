"""Further queries: sources and sinks, validated joins, coverage, resampling variants, diagnostics."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import grid, metrics, quality, scenarios, series, splits, statistics
from ..sources import tables
from .base import TELEMETRY, gap, haversine, r, rounded, table, telemetry


def _folder(spark) -> str:
    return f"{tables.shared_dir(spark)}/isobar-{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf):
    """Written as one CSV, read back as text, cast where it parses."""
    path = _folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"), "o_orderpriority")
    o.coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    back = tables.read_csv(spark, path, {"o_orderkey": "bigint", "price": "double"})
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("price").alias("parsed"), F.sum("o_orderkey").alias("ids"))


def phase_files(spark, sf):
    """Three written parts read back as one table with the part's tag, missing columns as null."""
    path, e = _folder(spark), table(spark, sf, "events").select("event_id", "value", "event_type")
    for k in range(3):
        part = e.filter(F.pmod("event_id", F.lit(3)) == k)
        tables.write_once(part if k else part.drop("event_type"), f"{path}/phase={k}")
    both = spark.read.option("mergeSchema", True).parquet(path)
    return both.groupBy(F.col("phase").cast("bigint").alias("phase")).agg(F.count("*").alias("n"), F.count("event_type").alias("typed"), F.sum("event_id").alias("ids"))


def extent(spark, sf):
    t = telemetry(spark, sf)
    return t.agg(F.count("*").alias("n"), F.count("reading").alias("valid"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *[r(f(x)).alias(f"{n}_{x}") for x in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])


def positional_zip(spark, sf):
    """The n-th of one ordering with the n-th of another, verified by a column."""
    e = table(spark, sf, "events")
    a = series.running(e.select("event_type", "event_id", F.col("ts").alias("a_ts")), ["event_type"], ["event_id"], {"k": F.lit(1)}).select("event_type", "a_ts", "k")
    b = series.running(e.select("event_type", "event_id", F.col("ts").alias("b_ts")), ["event_type"], ["b_ts", "event_id"], {"k": F.lit(1)}).select("event_type", "b_ts", "k")
    j = a.join(b, ["event_type", "k"])
    return j.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("a_ts") != F.col("b_ts")).cast("long")).alias("mismatched"))


def validated_merge(spark, sf):
    o, k = table(spark, sf, "orders"), table(spark, sf, "customer")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    sides = k.groupBy("c_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("left_most")).join(per.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("right_most")))
    return sides.join(k.join(per, k.c_custkey == per.o_custkey).agg(F.count("*").alias("matched"))).withColumn("one_to_one", (F.col("left_most") == 1) & (F.col("right_most") == 1))


def escalating_key(spark, sf):
    """By (order, day) where that is unique, else with the rounded price too."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", F.round("l_extendedprice").cast("long").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    n = F.count("*").over(Window.partitionBy("l_orderkey", "l_shipdate"))
    m = F.count("*").over(Window.partitionBy("l_orderkey", "l_shipdate", "price"))
    level = c.first_of([("key", F.col("n") == 1), ("key_price", F.col("m") == 1)], "ambiguous")
    return x.withColumns({"n": n, "m": m}).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def dateline(spark, sf):
    west, east = 150.0, -150.0
    inside = (F.col("lon") >= west) | (F.col("lon") <= east)
    return telemetry(spark, sf).groupBy(inside.alias("inside")).agg(F.count("*").alias("n"), r(F.avg(c.circular_distance("lon", F.lit(180.0))), 4).alias("mean_distance"))


def map_lookup(spark, sf):
    factor = F.create_map(*[F.lit(x) for kv in {"A": 3.114, "N": 3.206, "R": 2.75}.items() for x in kv])
    x = table(spark, sf, "lineitem")
    return x.groupBy("l_returnflag").agg(r(F.sum(F.element_at(factor, F.col("l_returnflag")) * F.col("l_quantity")), 3).alias("emitted"))


def entity_numbers(spark, sf):
    n = table(spark, sf, "nation").select("n_regionkey", "n_name").distinct()
    return n.select("n_name", F.concat(F.lit("S"), F.lpad(F.row_number().over(Window.orderBy("n_regionkey", "n_name")).cast("string"), 4, "0")).alias("entity_id"))


def top_orders(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", r("o_totalprice", 2).alias("price"))


def split_coverage(spark, sf):
    s = splits.stratified(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", 0.8, "s1")
    one = s.groupBy("o_orderkey").agg(F.countDistinct("split").alias("k")).agg(F.count("*").alias("covered"), F.sum((F.col("k") > 1).cast("long")).alias("overlapping"))
    return one.withColumn("complete", F.col("covered") == F.lit(table(spark, sf, "orders").count()))


def track_reasons(spark, sf):
    """Why a row starts or continues its track."""
    w = series.ordered(["user_id"], ["ts", "event_id"])
    t = telemetry(spark, sf).withColumns({"g": c.minutes_between(F.lag("ts").over(w), "ts"), "d": c.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")})
    why = c.first_of([("first", F.col("g").isNull()), ("gap", F.col("g") > 1440), ("jump", F.col("d") / F.nullif(F.col("g") / 60, F.lit(0.0)) > 400)], "continued")
    return t.groupBy(why.alias("reason")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def request_volume(spark, sf):
    """Grid points times hours of each month's box."""
    t = telemetry(spark, sf).withColumn("month", F.date_format("ts", "yyyy-MM"))
    b = t.groupBy("month", "event_type").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("x"), F.max("lon").alias("y"), F.countDistinct(F.to_date("ts")).alias("days"))
    points = (F.floor((F.col("b") - F.col("a")) / 0.5) + 1) * (F.floor((F.col("y") - F.col("x")) / 0.5) + 1)
    return b.select("month", "event_type", "days", points.cast("long").alias("points"), (points * F.col("days") * 24).cast("long").alias("values"))


def required_hours(spark, sf):
    h = telemetry(spark, sf).select("event_type", F.explode(F.array(F.date_trunc("HOUR", "ts"), F.date_trunc("HOUR", "ts") + F.expr("INTERVAL 1 HOUR"))).alias("h")).distinct()
    return h.groupBy("event_type").agg(F.count("*").alias("hours"))


def coverage_audit(spark, sf):
    t = telemetry(spark, sf).withColumns({"tile_row": c.tile("lat", -90, 10, 18), "tile_col": c.tile("lon", -180, 10, 36), "month": F.date_format("ts", "yyyy-MM")})
    routed, there = F.col("tile_col") % 5 > 0, F.hour("ts") % 6 < 5
    return t.groupBy("month").agg(F.count("*").alias("n"), F.sum(routed.cast("long")).alias("routed"), F.sum((routed & there).cast("long")).alias("matchable"), F.sum((routed & ~there).cast("long")).alias("missing_slice"))


def temporal_blend(spark, sf):
    """Values between the hours on either side: linear, circular, and Kelvin to Celsius."""
    e = telemetry(spark, sf)
    w = F.minute("ts") / 60.0
    low, high = F.pmod(F.hour("ts") * 37.0, F.lit(360.0)), F.pmod((F.hour("ts") + 1) * 37.0, F.lit(360.0))
    return e.select("event_id", r(grid.between(F.hour("ts") + 280.0, F.hour("ts") + 281.5, w) - 273.15).alias("celsius"), r(grid.between(low, high, w, circular=True), 4).alias("direction"))


def slot_rollup(spark, sf):
    """Half-hour slots, then hours of two slots."""
    e = telemetry(spark, sf).withColumn("slot", F.floor(F.minute("ts") / 30))
    s = e.groupBy("user_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour"), "slot").agg(F.avg("reading").alias("v"), F.count("*").alias("rows"))
    h = s.groupBy("user_id", "hour").agg(F.count("*").alias("slots"), F.sum("rows").alias("rows"), F.avg("v").alias("v"))
    return h.select("user_id", "hour", "slots", "rows", r(F.when(F.col("slots") == 2, F.col("v"))).alias("value"))


def distance_fallback(spark, sf):
    w = series.ordered(["user_id"], ["ts", "event_id"])
    t = telemetry(spark, sf).withColumns({"g": c.minutes_between(F.lag("ts").over(w), "ts"), "d": c.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")})
    v, source = c.coalesced([("given", F.when(F.col("event_id") % 4 == 0, F.col("value") / 10)), ("track", F.when(F.col("g").between(1, 300), F.col("d"))), ("speed", F.col("reading") / 6)])
    return t.select("event_id", r(v, 3).alias("distance"), F.when(v.isNotNull(), source).alias("source"))


def unit_consistency(spark, sf):
    x = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") * 60).alias("rate"), (F.col("l_quantity") / 100 + F.when(F.col("l_linenumber") == 3, 1e-6).otherwise(0.0)).alias("t"))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum((F.abs(F.col("rate") / 6000 - F.col("t")) <= 1e-10).cast("long")).alias("consistent"))


def month_days(spark, sf):
    """The days that a month's requests need, with the day after each."""
    d = table(spark, sf, "events").select(F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1))).alias("d")).distinct()
    return d.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.count("*").alias("days"), F.array_join(F.array_sort(F.collect_set(F.date_format("d", "dd"))), ",").alias("listed"))


def cluster_sums(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("e", F.col("l_extendedprice") / 1000 - F.col("l_quantity") * 1.4)
    return x.groupBy("l_suppkey").agg(F.count("*").alias("n"), r(F.sum(F.col("e") * F.col("e")), 3).alias("sse"), r(F.sum(F.abs("e")), 3).alias("sae"), r(F.stddev_samp("e")).alias("sd"), r(F.stddev_pop("e")).alias("sd_pop"))


def label_permutation(spark, sf):
    """A permutation test of two groups' means, over clusters, with hashed labels."""
    k = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r(F.avg("l_quantity"), 4).alias("m"))
    k = k.withColumn("g", (F.col("l_suppkey") % 2).cast("int"))
    d = k.select("l_suppkey", "m", "g", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("draw"))
    h = F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("l_suppkey").cast("string")))
    place = F.row_number().over(Window.partitionBy("draw").orderBy(h, "l_suppkey"))
    ones = k.agg(F.sum("g").alias("ones"))
    diff = lambda g: F.avg(F.when(g, F.col("m"))) - F.avg(F.when(~g, F.col("m")))
    drawn = d.withColumn("place", place).join(F.broadcast(ones)).groupBy("draw").agg(diff(F.col("place") <= F.col("ones")).alias("stat"))
    seen = k.agg(diff(F.col("g") == 1).alias("seen"))
    return drawn.join(F.broadcast(seen)).agg(r(F.max("seen"), 5).alias("observed"), r(F.avg((F.abs("stat") >= F.abs("seen") - 1e-9).cast("double")), 4).alias("p_value"))


def balanced_bootstrap(spark, sf):
    """The entity-balanced mean, entities drawn."""
    k = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("c")).agg(r(F.avg("l_quantity"), 5).alias("m")).withColumn("one", F.lit(1.0))
    b = statistics.cluster_bootstrap(k, "c", ["m", "one"], 300, F.col("m") / F.col("one"))
    return b.agg(r(F.avg("stat"), 5).alias("mean"), r(F.percentile("stat", 0.025), 5).alias("low"), r(F.percentile("stat", 0.975), 5).alias("high"))


def residual_spread(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("e", F.col("l_extendedprice") / 1000 - F.col("l_quantity") * 1.4)
    a = x.groupBy("l_suppkey").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.stddev_samp("l_extendedprice").alias("sd"), F.avg("l_extendedprice").alias("m"))
    a = a.join(series.quantiles(x, ["l_suppkey"], "e", [0.25, 0.5, 0.75]), "l_suppkey")
    return a.select("l_suppkey", r("rmse").alias("rmse"), r(F.col("rmse") * 1000 / F.col("sd")).alias("rmse_by_sd"), r(F.col("sd") / F.col("m")).alias("cv"), r("q1", 4).alias("median"), r(F.col("q2") - F.col("q0"), 4).alias("iqr"))


def calendar_coverage(spark, sf):
    s = splits.temporal_cut(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return s.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("entities"), F.countDistinct(F.date_format("ts", "yyyy-MM")).alias("months"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def local_response(spark, sf):
    x = scenarios.perturbed(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("q")), [("base", "q", 1.0, 0.0), ("more", "q", 1.05, 0.0)])
    m = metrics.scopes(x.withColumn("p", 0.04 + 1e-4 * F.col("q") * F.col("q")), "l_returnflag", "l_linestatus", [F.avg(F.when(F.col("perturbation") == "more", F.col("p"))).alias("a"), F.avg(F.when(F.col("perturbation") == "base", F.col("p"))).alias("b")])
    return m.select("l_returnflag", "l_linestatus", r(100 * (F.col("a") / F.col("b") - 1)).alias("change_pct"))


def count_checks(spark, sf):
    o = table(spark, sf, "orders")
    n, keys, bad = o.agg(F.count("*"), F.countDistinct("o_orderkey"), F.sum((~F.col("o_totalprice").between(0, 1e7)).cast("long"))).first()
    return quality.checks(spark, [("unique_orders", keys, n, 0), ("prices_in_range", bad, 0, 0), ("rows", n, n + 1, 0)])


QUERIES = {f.__name__: f for f in (
    csv_roundtrip, phase_files, extent, positional_zip, validated_merge, escalating_key, dateline, map_lookup, entity_numbers, top_orders, split_coverage,
    track_reasons, request_volume, required_hours, coverage_audit, temporal_blend, slot_rollup, distance_fallback, unit_consistency, month_days,
    cluster_sums, label_permutation, balanced_bootstrap, residual_spread, calendar_coverage, local_response, count_checks,
)}

R = rounded
STEPS = f"m AS (SELECT *, {gap('lag(ts) OVER w', 'ts')} AS g, {haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
E = "x AS (SELECT *, l_extendedprice / 1000 - l_quantity * 1.4::DOUBLE AS e FROM lineitem)"
HASH = "('0x' || substr(md5(a.range || '|' || b.range), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE"

SQL = {
    "csv_roundtrip": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 9 > 0) AS parsed, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY 1",
    "phase_files": "SELECT event_id % 3 AS phase, count(*) AS n, count(*) FILTER (WHERE event_id % 3 > 0) AS typed, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
    "extent": f"WITH {TELEMETRY} SELECT count(*) AS n, count(reading) AS valid, min(ts) AS first_ts, max(ts) AS last_ts, {R('min(lat)')} AS min_lat, {R('max(lat)')} AS max_lat, {R('min(lon)')} AS min_lon, {R('max(lon)')} AS max_lon FROM t",
    "positional_zip": """WITH a AS (SELECT event_type, ts AS a, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), b AS (SELECT event_type, ts AS b, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)
      SELECT event_type, count(*) AS n, sum((a <> b)::INT)::BIGINT AS mismatched FROM a JOIN b USING (event_type, k) GROUP BY 1""",
    "validated_merge": """WITH p AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1), l AS (SELECT max(n) AS left_most FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)),
      q AS (SELECT max(n) AS right_most FROM (SELECT count(*) AS n FROM p GROUP BY k)) SELECT left_most, right_most, (SELECT count(*) FROM customer JOIN p ON c_custkey = k) AS matched, left_most = 1 AND right_most = 1 AS one_to_one FROM l, q""",
    "escalating_key": """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS id, count(*) OVER (PARTITION BY l_orderkey, l_shipdate) AS n, count(*) OVER (PARTITION BY l_orderkey, l_shipdate, round(l_extendedprice)) AS m FROM lineitem)
      SELECT CASE WHEN n = 1 THEN 'key' WHEN m = 1 THEN 'key_price' ELSE 'ambiguous' END AS level, count(*) AS n, sum(id)::BIGINT AS ids FROM a GROUP BY 1""",
    "dateline": f"WITH {TELEMETRY} SELECT lon >= 150 OR lon <= -150 AS inside, count(*) AS n, {R('avg(abs(((lon - 180 + 180) % 360 + 360) % 360 - 180))', 4)} AS mean_distance FROM t GROUP BY 1",
    "map_lookup": f"SELECT l_returnflag, {R('''sum(CASE l_returnflag WHEN 'A' THEN 3.114::DOUBLE WHEN 'N' THEN 3.206::DOUBLE ELSE 2.75::DOUBLE END * l_quantity)''', 3)} AS emitted FROM lineitem GROUP BY 1",
    "entity_numbers": "SELECT n_name, 'S' || lpad((row_number() OVER (ORDER BY n_regionkey, n_name))::VARCHAR, 4, '0') AS entity_id FROM (SELECT DISTINCT n_regionkey, n_name FROM nation)",
    "top_orders": f"SELECT o_orderkey, {R('o_totalprice', 2)} AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "split_coverage": "SELECT count(DISTINCT o_orderkey) AS covered, 0::BIGINT AS overlapping, count(DISTINCT o_orderkey) = count(*) AS complete FROM orders",
    "track_reasons": f"WITH {TELEMETRY}, {STEPS} SELECT CASE WHEN g IS NULL THEN 'first' WHEN g > 1440 THEN 'gap' WHEN d / nullif(g / 60, 0) > 400 THEN 'jump' ELSE 'continued' END AS reason, count(*) AS n, min(event_id) AS first_id FROM m GROUP BY 1",
    "request_volume": f"""WITH {TELEMETRY}, b AS (SELECT strftime(ts, '%Y-%m') AS month, event_type, count(DISTINCT ts::DATE) AS days, ((floor((max(lat) - min(lat)) / 0.5) + 1) * (floor((max(lon) - min(lon)) / 0.5) + 1))::BIGINT AS points FROM t GROUP BY 1, 2)
      SELECT month, event_type, days, points, (points * days * 24)::BIGINT AS values FROM b""",
    "required_hours": "WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) + to_hours(k) AS h FROM events, (SELECT unnest([0, 1]) AS k)) SELECT event_type, count(*) AS hours FROM h GROUP BY 1",
    "coverage_audit": f"""WITH {TELEMETRY}, q AS (SELECT strftime(ts, '%Y-%m') AS month, floor((lon + 180) / 10)::INT % 5 > 0 AS ok, hour(ts) % 6 < 5 AS there FROM t)
      SELECT month, count(*) AS n, sum(ok::INT)::BIGINT AS routed, sum((ok AND there)::INT)::BIGINT AS matchable, sum((ok AND NOT there)::INT)::BIGINT AS missing_slice FROM q GROUP BY 1""",
    "temporal_blend": f"""WITH q AS (SELECT event_id, minute(ts) / 60.0::DOUBLE AS w, hour(ts) AS h, radians((hour(ts) * 37.0::DOUBLE) % 360) AS a, radians(((hour(ts) + 1) * 37.0::DOUBLE) % 360) AS b FROM events),
      s AS (SELECT *, sin(a) * (1 - w) + sin(b) * w AS y, cos(a) * (1 - w) + cos(b) * w AS x FROM q)
      SELECT event_id, {R('(h + 280) * (1 - w) + (h + 281.5::DOUBLE) * w - 273.15::DOUBLE')} AS celsius, {R('CASE WHEN w = 0 THEN degrees(a) ELSE (degrees(atan2(y, x)) + 360) % 360 END', 4)} AS direction FROM s""",
    "slot_rollup": f"""WITH {TELEMETRY}, s AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, floor(minute(ts) / 30) AS slot, avg(reading) AS v, count(*) AS rows FROM t GROUP BY user_id, date_trunc('hour', ts), 3)
      SELECT user_id, hour, count(*) AS slots, sum(rows)::BIGINT AS rows, {R('CASE WHEN count(*) = 2 THEN avg(v) END')} AS value FROM s GROUP BY 1, 2""",
    "distance_fallback": f"""WITH {TELEMETRY}, {STEPS} SELECT event_id, {R('coalesce(CASE WHEN event_id % 4 = 0 THEN value / 10 END, CASE WHEN g BETWEEN 1 AND 300 THEN d END, reading / 6)', 3)} AS distance,
      CASE WHEN event_id % 4 = 0 THEN 'given' WHEN g BETWEEN 1 AND 300 THEN 'track' WHEN reading IS NOT NULL THEN 'speed' END AS source FROM m""",
    "unit_consistency": """WITH x AS (SELECT l_returnflag, l_quantity::DOUBLE * 60 AS rate, l_quantity::DOUBLE / 100 + CASE WHEN l_linenumber = 3 THEN 1e-6::DOUBLE ELSE 0.0::DOUBLE END AS t FROM lineitem)
      SELECT l_returnflag, count(*) AS n, sum((abs(rate / 6000 - t) <= 1e-10)::INT)::BIGINT AS consistent FROM x GROUP BY 1""",
    "month_days": """WITH d AS (SELECT DISTINCT ts::DATE + k AS d FROM events, (SELECT unnest([0, 1])::INT AS k)) SELECT strftime(d, '%Y-%m') AS month, count(*) AS days, string_agg(DISTINCT strftime(d, '%d'), ',' ORDER BY strftime(d, '%d')) AS listed FROM d GROUP BY 1""",
    "cluster_sums": f"WITH {E} SELECT l_suppkey, count(*) AS n, {R('sum(e * e)', 3)} AS sse, {R('sum(abs(e))', 3)} AS sae, {R('stddev_samp(e)')} AS sd, {R('stddev_pop(e)')} AS sd_pop FROM x GROUP BY 1",
    "label_permutation": f"""WITH k AS (SELECT l_suppkey, {R('avg(l_quantity)', 4)} AS m, l_suppkey % 2 AS g FROM lineitem GROUP BY 1), p AS (SELECT range AS draw, m, row_number() OVER (PARTITION BY range ORDER BY md5(range || '|' || l_suppkey), l_suppkey) AS place FROM k, range(200)),
      s AS (SELECT draw, avg(m) FILTER (WHERE place <= (SELECT sum(g) FROM k)) - avg(m) FILTER (WHERE place > (SELECT sum(g) FROM k)) AS stat FROM p GROUP BY 1), o AS (SELECT avg(m) FILTER (WHERE g = 1) - avg(m) FILTER (WHERE g = 0) AS seen FROM k)
      SELECT {R('(SELECT seen FROM o)', 5)} AS observed, {R('avg((abs(stat) >= abs((SELECT seen FROM o)) - 1e-9)::INT)', 4)} AS p_value FROM s""",
    "balanced_bootstrap": f"""WITH k AS (SELECT l_suppkey AS c, {R('avg(l_quantity)', 5)} AS m FROM lineitem GROUP BY 1), d AS (SELECT a.range AS draw, floor({HASH} * (SELECT count(*) FROM k))::BIGINT AS c FROM range(300) a, range((SELECT count(*) FROM k)) b),
      f AS (SELECT draw, sum(m) / count(*) AS stat FROM d JOIN k USING (c) GROUP BY 1) SELECT {R('avg(stat)', 5)} AS mean, {R('quantile_cont(stat, 0.025)', 5)} AS low, {R('quantile_cont(stat, 0.975)', 5)} AS high FROM f""",
    "residual_spread": f"""WITH {E} SELECT l_suppkey, {R('sqrt(avg(e * e))')} AS rmse, {R('sqrt(avg(e * e)) * 1000 / stddev_samp(l_extendedprice)')} AS rmse_by_sd, {R('stddev_samp(l_extendedprice) / avg(l_extendedprice)')} AS cv, {R('median(e)', 4)} AS median,
      {R('quantile_cont(e, 0.75) - quantile_cont(e, 0.25)', 4)} AS iqr FROM x GROUP BY 1""",
    "calendar_coverage": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM events)
      SELECT CASE WHEN k <= greatest(1, least(total - 1, floor(total * 0.8::DOUBLE))) THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT user_id) AS entities, count(DISTINCT strftime(ts, '%Y-%m')) AS months, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1""",
    "local_response": f"""SELECT coalesce(l_returnflag, 'All') AS l_returnflag, coalesce(l_linestatus, 'All') AS l_linestatus,
      {R('100 * (avg(0.04::DOUBLE + 1e-4 * (l_quantity * 1.05::DOUBLE) * (l_quantity * 1.05::DOUBLE)) / avg(0.04::DOUBLE + 1e-4 * l_quantity * l_quantity) - 1)')} AS change_pct FROM lineitem GROUP BY CUBE (lineitem.l_returnflag, lineitem.l_linestatus)""",
    "count_checks": """SELECT * FROM (SELECT 'unique_orders' AS check, count(DISTINCT o_orderkey)::DOUBLE AS observed, count(*)::DOUBLE AS expected, count(DISTINCT o_orderkey) = count(*) AS passed FROM orders
      UNION ALL SELECT 'prices_in_range', (count(*) FILTER (WHERE NOT o_totalprice BETWEEN 0 AND 1e7))::DOUBLE, 0, count(*) FILTER (WHERE NOT o_totalprice BETWEEN 0 AND 1e7) = 0 FROM orders UNION ALL SELECT 'rows', count(*)::DOUBLE, count(*) + 1, false FROM orders)""",
}
