"""Queries on series: sessions, islands, resampling, brackets, angles, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import grid, series
from .base import TELEMETRY, gap, haversine, r, rounded, table, telemetry

DAY = 1440.0
G = gap("lag(ts) OVER w", "ts")


def gap_sessions(spark, sf):
    s = series.gap_sessions(telemetry(spark, sf), ["user_id"], "ts", "event_id", DAY)
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r(F.sum("value"), 4).alias("total"))


def jump_sessions(spark, sf):
    s = series.jump_sessions(telemetry(spark, sf), ["user_id"], "ts", "event_id", "lat", "lon", DAY, 250.0)
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), r(F.max("implied_speed"), 4).alias("top_speed"))


def segment_ids(spark, sf):
    s = series.gap_sessions(telemetry(spark, sf), ["user_id"], "ts", "event_id", DAY)
    return s.select("event_id", series.segment_id(F.col("user_id"), F.col("session_no")).alias("segment_id"))


def _hourly(spark, sf):
    return telemetry(spark, sf).withColumns({"hour": F.date_trunc("HOUR", "ts").cast("timestamp_ntz"), "flag": F.when(F.col("reading").isNotNull(), 1).otherwise(0)})


def dedup_bucket(spark, sf):
    d = series.dedup_states(_hourly(spark, sf), ["user_id", "hour"], "reading", "angle", "event_type", "flag", ["ts", "event_id"])
    return d.select("user_id", "hour", "rows", r("value_mean").alias("value_mean"), r("angle_mean", 4).alias("angle_mean"), "label_first", "flag_worst")


def _intervals(spark, sf):
    return series.effective_interval(telemetry(spark, sf), ["user_id"], "ts", "event_id", None, 60.0, 720.0)


def effective_interval(spark, sf):
    return _intervals(spark, sf).select("event_id", r("interval_minutes").alias("interval_minutes"), "interval_source")


def window_resample(spark, sf):
    w = series.window_states(_intervals(spark, sf), ["user_id"], "ts", "1 day", "reading", "angle", "interval_minutes", 2, 60.0, 1440.0)
    return w.select("user_id", "window_start", "slot_count", "status", *[r(x, 4).alias(x) for x in ("coverage_minutes", "value_mean", "angle_mean", "target", "target_partial")])


def end_aligned_totals(spark, sf):
    t = telemetry(spark, sf).withColumn("ts", F.date_trunc("HOUR", "ts").cast("timestamp_ntz"))
    return series.end_aligned_totals(t, ["user_id"], "ts", "6 hours", "reading").select("user_id", "window_start", r("total", 4).alias("total"), "parts")


def stability_rolling(spark, sf):
    s = series.stability(telemetry(spark, sf).filter("reading IS NOT NULL"), ["user_id"], "ts", "event_id", "reading", DAY, 3, 20.0)
    return s.select("event_id", "block_no", "rolling_n", r("rolling_std").alias("rolling_std"), "stable")


def null_islands(spark, sf):
    i = series.islands(telemetry(spark, sf), F.col("reading").isNull(), ["user_id"], ["ts", "event_id"])
    runs = i.groupBy("user_id", "island_no").agg(F.count("*").alias("n"), r(c.minutes_between(F.min("ts"), F.max("ts")), 4).alias("minutes"))
    bucket = c.first_of([("single", F.col("n") == 1), ("day", F.col("minutes") <= DAY)], "longer")
    return runs.withColumn("bucket", bucket)


def carry_forward(spark, sf):
    t = series.carry_forward(telemetry(spark, sf), ["user_id"], ["ts", "event_id"], "reading", "last_reading")
    return t.select("event_id", "last_reading")


def temporal_bracket(spark, sf):
    e = table(spark, sf, "events")
    line = e.filter("value > 50").select("event_type", "ts")  # all events between those of large values
    found = series.brackets(line, e.select("event_id", "event_type", "ts"), ["event_type"], "ts")
    span = c.minutes_between("lower_ts", "upper_ts")
    weight = F.when(span == 0, 0.0).when(span <= 2880, c.minutes_between("lower_ts", "ts") / F.nullif(span, F.lit(0.0)))
    return found.select("event_id", "lower_ts", "upper_ts", r(weight).alias("weight"))


def angles(spark, sf):
    t = telemetry(spark, sf)
    rel = c.wrap_180(F.col("angle") - F.col("lon"))
    return t.select(
        "event_id", r(c.wrap_360(F.col("lon") * 3)).alias("wrapped"), r(c.wrap_180(F.col("angle") + 200)).alias("wrapped_180"), r(rel).alias("relative"),
        r(c.circular_distance("angle", F.lit(350.0))).alias("distance"), r(c.apparent_speed(F.lit(12.0), F.col("value") / 10, rel), 4).alias("apparent"),
        r(F.sin(F.radians("angle")), 4).alias("s"), c.first_of([("a", F.abs(rel) <= 45), ("b", F.abs(rel) >= 135)], "side").alias("sector"),
    )


def wind_from_uv(spark, sf):
    t = telemetry(spark, sf).withColumns({"u": (F.col("event_id") % 41 - 20) / 2.0, "v": (F.col("event_id") % 29 - 14) / 2.0})
    return t.select("event_id", r(c.speed_from_uv("u", "v")).alias("speed_kn"), r(c.direction_from_uv("u", "v"), 4).alias("from_deg"))


def haversine_steps(spark, sf):
    w = series.ordered(["user_id"], ["ts", "event_id"])
    d = c.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return telemetry(spark, sf).select("event_id", r(d, 3).alias("distance_nm"))


def _grid(spark, circular: bool):
    i, j = F.col("i"), F.col("j")
    value = F.pmod(i * 40.0 + j * 15.0, F.lit(360.0)) if circular else 2.0 * i - 0.5 * j + 7
    cells = spark.range(25).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(72))).alias("j"))
    return cells.withColumn("field", F.when((i * 73 + j) % 97 > 0, value))


def _points(spark, sf):
    return grid.cell(telemetry(spark, sf), "lat", "lon", -60.0, -180.0, 5.0, 25, 73)


def bilinear_interp(spark, sf):
    p, g = _points(spark, sf), _grid(spark, False)
    strict = grid.bilinear(p, g, "event_id", [], "field").withColumnRenamed("field", "strict_value")
    partial = grid.bilinear(p, g, "event_id", [], "field", partial=True).withColumnRenamed("field", "partial_value")
    return strict.join(partial, "event_id").select("event_id", r("strict_value").alias("strict_value"), r("partial_value").alias("partial_value"))


def circular_interp(spark, sf):
    found = grid.bilinear(_points(spark, sf), _grid(spark, True), "event_id", [], "field", circular=True)
    return found.select("event_id", r("field", 4).alias("field"))


def tile_route(spark, sf):
    manifest = spark.range(36).select(
        F.concat(F.lit("p"), F.col("id")).alias("part"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda k: F.concat(k.cast("string"), F.lit(":"), F.col("id").cast("string"))), "|").alias("tile_cells"),
    ).filter("id % 5 > 0")
    found = grid.routed(telemetry(spark, sf), manifest, "lat", "lon")
    return found.groupBy(F.coalesce("part", F.lit("none")).alias("part"), "tile_row").agg(F.count("*").alias("n"))


def grid_nodes(spark, sf):
    return grid.nodes(_points(spark, sf)).groupBy("i").agg(F.count("*").alias("nodes"))


def circular_span(spark, sf):
    t = telemetry(spark, sf).withColumn("bin", c.tile(F.col("lon") / 2, -180, 10, 36))
    return grid.circular_span(t, ["event_type"], "bin", 36)


def tile_components(spark, sf):
    t = telemetry(spark, sf).select(c.tile("lat", -90, 10, 18).alias("tile_row"), c.tile("lon", -180, 10, 36).alias("tile_col"))
    return grid.tile_components(t).groupBy("component").agg(F.count("*").alias("tiles"))


def request_areas(spark, sf):
    t = telemetry(spark, sf)
    box = t.groupBy("event_type").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("x"), F.max("lon").alias("y"))
    return box.select("event_type", *[v.cast("double").alias(k) for k, v in grid.area([F.col("a"), F.col("b")], [F.col("x"), F.col("y")], 0.3, 0.5).items()])


def monthly_audit(spark, sf):
    t = telemetry(spark, sf).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return t.groupBy("month").agg(
        F.count("*").alias("n"), F.count("reading").alias("valid"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"),
        F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("types"), r(F.min("lat")).alias("south"), r(F.max("lat")).alias("north"),
    )


def json_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("k_count"), F.max(k).alias("k_max"))


QUERIES = {f.__name__: f for f in (
    gap_sessions, jump_sessions, segment_ids, dedup_bucket, effective_interval, window_resample, end_aligned_totals, stability_rolling, null_islands,
    carry_forward, temporal_bracket, angles, wind_from_uv, haversine_steps, bilinear_interp, circular_interp, tile_route, grid_nodes, circular_span,
    tile_components, request_areas, monthly_audit, json_props,
)}

W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
RUN = "sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT"
SESSIONS = f"""WITH {TELEMETRY}, g AS (SELECT *, CASE WHEN {G} IS NULL OR {G} > 1440 THEN 1 ELSE 0 END AS s FROM t {W}),
n AS (SELECT *, {RUN} AS session_no FROM g)"""
D = haversine("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")
CIRC = "CASE WHEN sqrt(({s}) ** 2 + ({c}) ** 2) >= 1e-12 THEN (degrees(atan2({s}, {c})) + 360.0) % 360.0 END"


def circ(angle: str, weight: str = "1.0") -> str:
    return CIRC.format(s=f"sum(sin(radians({angle})) * {weight})", c=f"sum(cos(radians({angle})) * {weight})")


INTERVALS = f"""{TELEMETRY}, a AS (SELECT *, {gap('ts', 'lead(ts) OVER w')} AS ahead FROM t {W}),
i AS (SELECT *, CASE WHEN ahead > 0 AND ahead <= 720 THEN ahead ELSE 60.0 END AS interval_minutes, CASE WHEN ahead > 0 AND ahead <= 720 THEN 'next' ELSE 'nominal' END AS interval_source FROM a)"""
CELLS = """p AS (SELECT event_id, least(floor((lat + 60) / 5), 23)::INT AS i, least(floor((lon + 180) / 5), 71)::INT AS j, (lat + 60) / 5 AS y, (lon + 180) / 5 AS x FROM t),
k AS (SELECT event_id, i + di AS i, j + dj AS j, (CASE WHEN di = 1 THEN y - i ELSE 1 - (y - i) END) * (CASE WHEN dj = 1 THEN x - j ELSE 1 - (x - j) END) AS w
  FROM p, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj))"""
LINEAR_GRID = "g AS (SELECT a.i::INT AS i, b.j::INT AS j, CASE WHEN (a.i * 73 + b.j) % 97 > 0 THEN 2.0::DOUBLE * a.i - 0.5::DOUBLE * b.j + 7 END AS v FROM range(25) a(i), range(73) b(j))"
CIRCULAR_GRID = "g AS (SELECT a.i::INT AS i, b.j::INT AS j, CASE WHEN (a.i * 73 + b.j) % 97 > 0 THEN ((a.i * 40 + b.j * 15) % 360)::DOUBLE END AS v FROM range(25) a(i), range(73) b(j))"
WHOLE = "min(CASE WHEN v IS NULL THEN 0 ELSE 1 END) = 1"
REL = "(((angle - lon) + 180) % 360 + 360) % 360 - 180"

SQL = {
    "gap_sessions": f"{SESSIONS} SELECT user_id, session_no, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, {rounded('sum(value)', 4)} AS total FROM n GROUP BY ALL",
    "jump_sessions": f"""WITH {TELEMETRY}, m AS (SELECT *, {G} AS gm, {D} AS d FROM t {W}), v AS (SELECT *, d / nullif(gm / 60, 0) AS speed FROM m),
      g AS (SELECT *, CASE WHEN gm IS NULL OR gm > 1440 OR coalesce(speed > 250, false) THEN 1 ELSE 0 END AS s FROM v), n AS (SELECT *, {RUN} AS session_no FROM g)
      SELECT user_id, session_no, count(*) AS n, {rounded('max(speed)', 4)} AS top_speed FROM n GROUP BY ALL""",
    "segment_ids": f"{SESSIONS} SELECT event_id, user_id::VARCHAR || '_S' || lpad(session_no::VARCHAR, 5, '0') AS segment_id FROM n",
    "dedup_bucket": f"""WITH {TELEMETRY} SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS rows, {rounded('avg(reading)')} AS value_mean, {rounded(circ('angle'), 4)} AS angle_mean,
      first(event_type ORDER BY ts, event_id) AS label_first, min(CASE WHEN reading IS NULL THEN 0 ELSE 1 END)::INT AS flag_worst FROM t GROUP BY user_id, date_trunc('hour', ts)""",
    "effective_interval": f"WITH {INTERVALS} SELECT event_id, {rounded('interval_minutes')} AS interval_minutes, interval_source FROM i",
    "window_resample": f"""WITH {INTERVALS}, a1 AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS slot_count, count(reading) AS nv, sum(interval_minutes) AS cov,
      sum(reading * interval_minutes) / nullif(sum(CASE WHEN reading IS NOT NULL THEN interval_minutes END), 0) AS vm, {circ('angle', 'interval_minutes')} AS am, sum(reading * interval_minutes / 60) AS integral
      FROM i GROUP BY user_id, date_trunc('day', ts)),
      b AS (SELECT *, CASE WHEN slot_count < 2 THEN 'wrong_slot_count' WHEN nv < slot_count THEN 'invalid_value' WHEN NOT cov BETWEEN 60 AND 1440 THEN 'coverage' ELSE 'complete' END AS status FROM a1)
      SELECT user_id, window_start, slot_count, status, {rounded('cov', 4)} AS coverage_minutes, {rounded('vm', 4)} AS value_mean, {rounded('am', 4)} AS angle_mean,
      {rounded("CASE WHEN status = 'complete' THEN integral END", 4)} AS target, {rounded('integral', 4)} AS target_partial FROM b""",
    "end_aligned_totals": f"""WITH {TELEMETRY} SELECT user_id, time_bucket(INTERVAL '6 hours', date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 MICROSECOND)::TIMESTAMP AS window_start, {rounded('sum(reading)', 4)} AS total,
      count(reading) AS parts FROM t GROUP BY 1, 2""",
    "stability_rolling": f"""WITH {TELEMETRY}, f AS (SELECT * FROM t WHERE reading IS NOT NULL), g AS (SELECT *, CASE WHEN {G} IS NULL OR {G} > 1440 THEN 1 ELSE 0 END AS s FROM f {W}),
      n AS (SELECT *, {RUN} AS block_no FROM g), o AS (SELECT *, count(reading) OVER v AS rolling_n, stddev_samp(reading) OVER v AS sd FROM n
      WINDOW v AS (PARTITION BY user_id, block_no ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
      SELECT event_id, block_no, rolling_n, {rounded('sd')} AS rolling_std, rolling_n < 3 OR sd <= 20 AS stable FROM o""",
    "null_islands": f"""WITH {TELEMETRY}, m AS (SELECT *, reading IS NULL AS z, coalesce(lag(reading IS NULL) OVER w, false) AS b FROM t {W}), g AS (SELECT *, CASE WHEN z AND NOT b THEN 1 ELSE 0 END AS s FROM m),
      n AS (SELECT *, {RUN} AS island_no FROM g), q AS (SELECT user_id, island_no, count(*) AS n, {rounded(gap('min(ts)', 'max(ts)'), 4)} AS minutes FROM n WHERE z GROUP BY ALL)
      SELECT *, CASE WHEN n = 1 THEN 'single' WHEN minutes <= 1440 THEN 'day' ELSE 'longer' END AS bucket FROM q""",
    "carry_forward": f"""WITH {TELEMETRY} SELECT event_id, last_value(reading IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_reading FROM t""",
    "temporal_bracket": f"""WITH l AS (SELECT DISTINCT event_type, ts FROM events WHERE value > 50), q AS (SELECT event_id, event_type, ts FROM events),
      a AS (SELECT q.*, l.ts AS lower_ts FROM q ASOF LEFT JOIN l ON q.event_type = l.event_type AND q.ts >= l.ts), b AS (SELECT a.*, l.ts AS upper_ts FROM a ASOF LEFT JOIN l ON a.event_type = l.event_type AND a.ts <= l.ts)
      SELECT event_id, lower_ts, upper_ts, {rounded(f"CASE WHEN {gap('lower_ts', 'upper_ts')} = 0 THEN 0.0 WHEN {gap('lower_ts', 'upper_ts')} <= 2880 THEN {gap('lower_ts', 'ts')} / nullif({gap('lower_ts', 'upper_ts')}, 0) END")} AS weight FROM b""",
    "angles": f"""WITH {TELEMETRY} SELECT event_id, {rounded('((lon * 3) % 360 + 360) % 360')} AS wrapped, {rounded('((angle + 200) + 180) % 360 - 180')} AS wrapped_180, {rounded(REL)} AS relative,
      {rounded('abs((((angle - 350) + 180) % 360 + 360) % 360 - 180)')} AS distance, {rounded(f'sqrt(greatest(144 + (value / 10) ** 2 - 24 * (value / 10) * cos(radians({REL})), 0))', 4)} AS apparent,
      {rounded('sin(radians(angle))', 4)} AS s, CASE WHEN abs({REL}) <= 45 THEN 'a' WHEN abs({REL}) >= 135 THEN 'b' ELSE 'side' END AS sector FROM t""",
    "wind_from_uv": f"""WITH z AS (SELECT event_id, (event_id % 41 - 20) / 2.0::DOUBLE AS u, (event_id % 29 - 14) / 2.0::DOUBLE AS v FROM events)
      SELECT event_id, {rounded('sqrt(u * u + v * v) * 1.9438444924406048::DOUBLE')} AS speed_kn, {rounded('CASE WHEN sqrt(u * u + v * v) >= 0.01 THEN (degrees(atan2(-u, -v)) + 360) % 360 END', 4)} AS from_deg FROM z""",
    "haversine_steps": f"WITH {TELEMETRY} SELECT event_id, {rounded(D, 3)} AS distance_nm FROM t {W}",
    "bilinear_interp": f"""WITH {TELEMETRY}, {CELLS}, {LINEAR_GRID} SELECT event_id, {rounded(f'CASE WHEN {WHOLE} THEN sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0) END')} AS strict_value,
      {rounded('sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0)')} AS partial_value FROM k LEFT JOIN g USING (i, j) WHERE w > 0 GROUP BY event_id""",
    "circular_interp": f"""WITH {TELEMETRY}, {CELLS}, {CIRCULAR_GRID} SELECT event_id, {rounded(f'CASE WHEN {WHOLE} THEN {circ("v", "w")} END', 4)} AS field FROM k LEFT JOIN g USING (i, j) WHERE w > 0 GROUP BY event_id""",
    "tile_route": f"""WITH {TELEMETRY}, q AS (SELECT floor((lat + 90) / 10)::INT AS tile_row, floor((lon + 180) / 10)::INT AS c FROM t)
      SELECT CASE WHEN c % 5 > 0 THEN 'p' || c ELSE 'none' END AS part, tile_row, count(*) AS n FROM q GROUP BY ALL""",
    "grid_nodes": f"WITH {TELEMETRY}, {CELLS} SELECT i, count(DISTINCT j) AS nodes FROM k GROUP BY i",
    "circular_span": f"""WITH {TELEMETRY}, b AS (SELECT DISTINCT event_type, floor((lon / 2 + 180) / 10)::INT AS bin FROM t),
      g AS (SELECT event_type, coalesce(lead(bin) OVER (PARTITION BY event_type ORDER BY bin), min(bin) OVER (PARTITION BY event_type) + 36) - bin AS gap FROM b)
      SELECT event_type, (36 - max(gap) + 1)::BIGINT AS span_bins FROM g GROUP BY event_type""",
    "request_areas": f"""WITH {TELEMETRY} SELECT event_type, floor((min(lat) - 0.3) / 0.5) * 0.5 AS south, ceil((max(lat) + 0.3) / 0.5) * 0.5 AS north, floor((min(lon) - 0.3) / 0.5) * 0.5 AS west, ceil((max(lon) + 0.3) / 0.5) * 0.5 AS east
      FROM t GROUP BY event_type""",
    "monthly_audit": f"""WITH {TELEMETRY} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, count(reading) AS valid, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days,
      string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types, {rounded('min(lat)')} AS south, {rounded('max(lat)')} AS north FROM t GROUP BY 1""",
    "json_props": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, count(props->>'$.k') AS k_count, max((props->>'$.k')::BIGINT) AS k_max FROM events GROUP BY event_type",
}
