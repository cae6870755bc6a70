"""Queries on standardisation and on programs that are made of several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import metrics, quality, scenarios, series, standard
from .base import TELEMETRY, gap, r, rounded, table, telemetry

SHIP_TEXTS = ["Bulk Carrier", "散货船", " CONTAINER ship", "集装箱船", "Oil Tanker", "化学品船", "Ro Ro", "oil/bulk"]
PHASE_TEXTS = ["Cruising", "巡航", "Manoeuvring", "at anchor", "Berth/Idle", "锚泊", "Drifting Slow"]
HEADERS = ["Length Overall (m)", "LBP", "lbp_m", "Ship Length", "Beam length", "length", "Wave length", "总长", "cable length total", "Draught"]
SCORES = [
    standard.NameScore("between_perpendiculars", 50, ("lengthbetweenperpendiculars", "lengthbp", "lbp", "垂线间长")),
    standard.NameScore("overall", 40, ("lengthoverall", "overalllength", "loa", "总长")),
    standard.NameScore("ship_length", 30, ("shiplength", "vessellength", "船长")),
    standard.NameScore("generic", 20, ("length",), "edge"),
    standard.NameScore("weak", 10, ("length", "长度")),
]


def _nth(texts, at):
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (at % len(texts) + 1).cast("int"))


def text_classes(spark, sf):
    e = table(spark, sf, "events")
    ship, phase = standard.text_class(_nth(SHIP_TEXTS, F.col("event_id")), standard.SHIP_TYPES), standard.text_class(_nth(PHASE_TEXTS, F.col("event_id")), standard.PHASES, "/ ")
    return e.groupBy(ship.alias("ship_type"), phase.alias("phase")).agg(F.count("*").alias("n"))


def utc_parse(spark, sf):
    """Times that were written in six ways."""
    e = table(spark, sf, "events")
    full = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    way = F.col("event_id") % 6
    text = (
        F.when(way == 0, full).when(way == 1, F.date_format("ts", "yyyy/MM/dd HH:mm")).when(way == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(way == 3, F.concat(full, F.lit("+08:00"))).when(way == 4, F.date_format("ts", "yyyy-MM-dd")).otherwise("not a time")
    )
    return e.select("event_id", standard.utc_time(text).alias("utc"), standard.utc_time(text, "Asia/Shanghai").alias("utc_of_local"))


def ship_age(spark, sf):
    e = table(spark, sf, "events").withColumn("delivered", F.date_sub(F.lit("2020-01-01").cast("date"), (F.col("event_id") % 9000).cast("int")).cast("timestamp_ntz"))
    return e.select("event_id", r(standard.age_years("ts", "delivered")).alias("age_years"))


def unit_vectors(spark, sf):
    size = F.when(F.col("event_id") % 7 == 0, 1.2).when(F.col("event_id") % 7 == 1, 1e-7).when(F.col("event_id") % 7 == 2, 0.6).otherwise(1.0)
    t = telemetry(spark, sf).withColumns({"s": F.when(F.col("event_id") % 11 > 0, F.sin(F.radians("angle")) * size), "co": F.cos(F.radians("angle")) * size})
    s, co = standard.unit_vector("s", "co")
    return t.select("event_id", r(s).alias("unit_sin"), r(co).alias("unit_cos"))


def _ships(spark, sf):
    x = table(spark, sf, "lineitem")
    length = F.when(F.col("l_linenumber") < 7, F.col("l_quantity") * 7 - 14)
    return x.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("source"), (8 + F.col("l_quantity") / 5).alias("speed"),
        (F.col("l_tax") * 200).alias("wind"), (F.col("l_discount") * 30).alias("wave"), (F.col("l_extendedprice") / 10000).alias("draught"), length.alias("length"),
        F.when(F.col("l_quantity") != 13, (F.col("l_discount") - 0.04) * F.col("l_quantity") * 3).alias("trim"), F.lit(9.0).alias("design"),
    )


def interaction_features(spark, sf):
    products = standard.ridge_products("speed", ["wind", "wave", "draught", "trim"], ("draught", "trim"))
    m = standard.interactions(_ships(spark, sf), products)
    names = ["speed_sq", "speed_cu", "speed_x_wind", "speed_x_wave", "speed_x_draught", "speed_x_trim", "draught_x_trim"]
    return m.groupBy("kind").agg(*[r(F.avg(n), 4).alias(n) for n in names])


def draught_ends(spark, sf):
    d = standard.draught_ends(_ships(spark, sf), "draught", "trim", "design")
    return d.groupBy("kind").agg(F.count("least_draught").alias("n"), *[r(f(x), 5).alias(f"{n}_{x}") for x in ("fore_draught", "aft_draught", "least_draught", "least_design_ratio") for n, f in (("min", F.min), ("mean", F.avg))])


def trim_status(spark, sf):
    t = standard.trim_checked(_ships(spark, sf), "trim", "length")
    return t.groupBy("trim_status").agg(F.count("*").alias("n"), F.count("trim_kept").alias("kept"), r(F.max(F.abs("trim_kept")), 5).alias("most"), r(F.avg("trim_hard_limit"), 5).alias("mean_limit"))


def lineage_rows(spark, sf):
    """Row numbers over the whole table in the order of time, by ranges."""
    n = series.running(table(spark, sf, "events").select("event_id", "ts"), [], ["ts", "event_id"], {"row_no": F.lit(1)})
    return n.select("event_id", F.col("row_no").cast("bigint").alias("row_no"))


def scored_columns(spark, sf):
    best, found = standard.chosen_column(HEADERS, SCORES, ("beam", "breadth", "wave", "draught"), ("m", "meter", "metre"))
    return spark.createDataFrame([(n, s, k, n == best) for n, s, k in found], "name string, score int, category string, chosen boolean")


def missing_rates(spark, sf):
    t = telemetry(spark, sf)
    m = standard.missing_rates(t, ["event_id", "reading", "angle", "salinity"])
    return m.select("column", "present", "rows", "missing", r("missing_share").alias("missing_share"))


def _interval_rows(spark, sf):
    return series.effective_interval(telemetry(spark, sf), ["user_id"], "ts", "event_id", None, 60.0, 720.0)


def joined_resample(spark, sf):
    """State windows with the totals of intervals that end in them."""
    rows = _interval_rows(spark, sf)
    states = series.window_states(rows, ["user_id"], "ts", "1 day", "reading", "angle", "interval_minutes", 2, 60.0, 1440.0)
    totals = series.end_aligned_totals(rows.withColumn("ts", F.date_trunc("HOUR", "ts").cast("timestamp_ntz")), ["user_id"], "ts", "1 day", "reading")
    j = states.join(totals, ["user_id", "window_start"], "left")
    return j.select("user_id", "window_start", "status", r("target", 4).alias("target"), r("total", 4).alias("total"), "parts", (F.col("status").eqNullSafe("complete") & F.col("total").isNotNull()).alias("usable"))


def native_windows(spark, sf):
    """Rows that come at window length already: brought to the window's start, one row a window, with what was merged."""
    t = telemetry(spark, sf).withColumns({"slot": F.date_trunc("HOUR", "ts").cast("timestamp_ntz"), "flag": F.when(F.col("reading").isNotNull(), 1).otherwise(0)})
    d = series.dedup_states(t, ["user_id", "slot"], "reading", "angle", "event_type", "flag", ["ts", "event_id"])
    status = c.first_of([("missing_value", F.col("value_mean").isNull()), ("merged", F.col("rows") > 1)], "native")
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("windows"), F.sum("rows").alias("rows"), r(F.sum(F.col("value_mean") / 6), 3).alias("target"))


def clean_program(spark, sf):
    """Sessions, stability, intervals, physical limits, vectors, strict windows and rules in one program; what each phase and reason leaves."""
    t = series.gap_sessions(telemetry(spark, sf), ["user_id"], "ts", "event_id", 1440.0)
    t = t.withColumns({"speed": c.in_range_or_null(F.col("value") / 10, 0.0, 30.0), "reading": c.in_range_or_null("reading", 0.0, 120.0), "s": F.sin(F.radians("angle")), "co": F.cos(F.radians("angle"))})
    unit = standard.unit_vector("s", "co")
    t = series.effective_interval(t.withColumns({"unit_sin": unit[0], "unit_cos": unit[1]}), ["user_id", "session_no"], "ts", "event_id", None, 60.0, 720.0)
    w = t.groupBy("user_id", "session_no", F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("slots"), F.count("reading").alias("valid"), F.sum("interval_minutes").alias("minutes"), c.weighted_mean("speed", "interval_minutes").alias("speed"),
        c.from_sin_cos(F.sum("unit_sin"), F.sum("unit_cos")).alias("course"), F.sum(F.col("reading") * F.col("interval_minutes") / 60).alias("target"),
    )
    rules = [
        quality.Rule("slots", F.col("slots") < 2), quality.Rule("missing_value", F.col("valid") < F.col("slots")),
        quality.Rule("coverage", ~F.col("minutes").between(60, 1440)), quality.Rule("no_speed", F.col("speed").isNull()),
    ]
    phase = c.first_of([("cruise", F.col("speed") > 8), ("maneuver", F.col("speed") >= 1)], "anchor_berth")
    j = quality.judged(w, rules).withColumn("phase", phase)
    return j.groupBy("phase", F.coalesce("first_failed_rule", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("windows"), r(F.sum("target"), 3).alias("target"), r(F.avg("course"), 3).alias("mean_course"))


def phase_extract(spark, sf):
    """Rows of each phase whose static columns are all there; a phase without rows keeps its line."""
    x = _ships(spark, sf).withColumn("phase", c.first_of([("cruise", F.col("speed") > 12), ("maneuver", F.col("speed") >= 8)], "anchor_berth"))
    found = x.groupBy("phase").agg(F.count("*").alias("rows"), F.sum(c.complete("length", "design").cast("long")).alias("complete"), F.countDistinct("l_suppkey").alias("entities"))
    names = spark.createDataFrame([(p,) for p in ("cruise", "maneuver", "anchor_berth")], "phase string")
    return names.join(found, "phase", "left").fillna(0, ["rows", "complete", "entities"])


def service_speed_review(spark, sf):
    """Speeds over both the 99th percentile and the upper fence of their entity, or over 1.5 times its service speed."""
    x = _ships(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("speed") + F.when(F.col("l_orderkey") % 97 == 0, 12.0).otherwise(0.0)).alias("speed"))
    f = quality.upper_fences(x, ["l_suppkey"], "speed", 0.99, 1.5).withColumn("service", 12.0 + F.col("l_suppkey") % 5)
    j = x.join(f, "l_suppkey").withColumns({"extreme": (F.col("speed") > F.col("high_quantile")) & (F.col("speed") > F.col("iqr_fence")), "over_service": F.col("speed") > 1.5 * F.col("service")})
    return j.groupBy("l_suppkey").agg(F.count("*").alias("rows"), *[F.sum(F.col(k).cast("long")).alias(k) for k in ("extreme", "over_service")], F.sum((F.col("extreme") | F.col("over_service")).cast("long")).alias("flagged"))


def trim_report(spark, sf):
    x = _ships(spark, sf)
    a = x.groupBy("kind", "l_suppkey").agg(F.count("*").alias("rows"), F.count("trim").alias("finite"), F.sum((F.coalesce(F.col("trim") < -2, F.lit(False))).cast("long")).alias("below"), r(F.min("trim")).alias("least"), r(F.max("trim")).alias("most"))
    return a.withColumn("below_pct", r(100 * F.col("below") / F.nullif(F.col("finite"), F.lit(0))))


def range_recheck(spark, sf):
    limits = {"wave": (0.0, 2.5, False), "wind": (0.0, 12.0, True), "trim": (-6.0, 6.0, True), "length": (0.0, 320.0, False)}
    a = standard.range_audit(_ships(spark, sf), ["kind"], limits)
    return a.select("kind", "variable", "rows", "finite", "in_range", r("least").alias("least"), r("most").alias("most"))


def model_completeness(spark, sf):
    x = _ships(spark, sf)
    needed = ["speed", "wind", "wave", "draught", "trim", "length"]
    lacks = F.concat_ws("+", *[F.when(~F.coalesce(c.finite(n), F.lit(False)), F.lit(n)) for n in needed])
    return x.groupBy("kind", lacks.alias("lacks")).agg(F.count("*").alias("n"))


def joint_support(spark, sf):
    """Scenario rows whose every variable is within what training rows of their kind have, and how many stay in each scope."""
    x = _ships(spark, sf)
    train = x.filter("l_orderkey % 5 > 0 AND speed >= 9.5 AND wave <= 2.7")
    v = scenarios.with_levels(x.filter("l_orderkey % 5 = 0"), [5.0, 10.0], "level").withColumn("slow", F.col("speed") * (1 - F.col("level") / 100))
    bounds = train.groupBy("kind").agg(*[f(n).alias(f"{k}_{n}") for n in ("speed", "wave", "draught") for k, f in (("low", F.min), ("high", F.max))])
    j = v.join(F.broadcast(bounds), "kind", "left")  # a row a kind
    inside = {n: F.coalesce(F.col(at).between(F.col(f"low_{n}"), F.col(f"high_{n}")), F.lit(False)) for n, at in (("speed", "slow"), ("wave", "wave"), ("draught", "draught"))}
    j = j.withColumns({f"in_{n}": x for n, x in inside.items()}).withColumn("joint", F.col("in_speed") & F.col("in_wave") & F.col("in_draught"))
    shares = [r(100 * F.avg(F.col(n).cast("double")), 5).alias(f"{n}_pct") for n in ("in_speed", "in_wave", "in_draught", "joint")]
    return metrics.scopes(j.withColumn("level", F.col("level").cast("string")), "kind", "level", [F.count("*").alias("n"), *shares])


def threshold_evidence(spark, sf):
    """A metric out of result tables of two shapes: a column of its own, or a row that names it."""
    x = _ships(spark, sf)
    wide = x.groupBy("kind").agg(r(F.avg("speed")).alias("mean_speed"), r(F.max("wave")).alias("top_wave"))
    long = wide.unpivot(["kind"], ["mean_speed", "top_wave"], "metric", "value")
    from_long = long.filter(F.contains(F.lower("metric"), F.lit("speed"))).select("kind", F.lit("long").alias("shape"), "value")
    first = next(n for n in wide.columns if "speed" in n)
    both = from_long.unionByName(wide.select("kind", F.lit("wide").alias("shape"), F.col(first).alias("value")))
    return both.withColumn("passes", F.col("value") >= 13.1)


QUERIES = {f.__name__: f for f in (
    text_classes, utc_parse, ship_age, unit_vectors, interaction_features, draught_ends, trim_status, lineage_rows, scored_columns, missing_rates, joined_resample, native_windows, clean_program,
    phase_extract, service_speed_review, trim_report, range_recheck, model_completeness, joint_support, threshold_evidence,
)}

_LIST = lambda texts: "[" + ", ".join(f"'{t}'" for t in texts) + "]"
_CLASS = lambda plain, words: "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({plain}, {chr(39)}{w}{chr(39)})' for w in names)} THEN '{k}'" for k, names in words.items()) + f" ELSE {plain} END"
SHIPS = """x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS kind, l_linestatus AS source, 8 + l_quantity::DOUBLE / 5 AS speed, l_tax::DOUBLE * 200 AS wind,
  l_discount::DOUBLE * 30 AS wave, l_extendedprice::DOUBLE / 10000 AS draught, CASE WHEN l_linenumber < 7 THEN l_quantity::DOUBLE * 7 - 14 END AS length,
  CASE WHEN l_quantity <> 13 THEN (l_discount::DOUBLE - 0.04::DOUBLE) * l_quantity::DOUBLE * 3 END AS trim, 9.0::DOUBLE AS design FROM lineitem)"""
_CIRC = "CASE WHEN sqrt(({s}) ** 2 + ({c}) ** 2) >= 1e-12 THEN (degrees(atan2({s}, {c})) + 360.0) % 360.0 END"
_INTERVAL = f"""i AS (SELECT *, CASE WHEN ahead > 0 AND ahead <= 720 THEN ahead ELSE 60.0::DOUBLE END AS minutes FROM (
  SELECT *, {gap("ts", "lead(ts) OVER w")} AS ahead FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""
_AUDIT = lambda v, low, high, op: f"""SELECT kind, '{v}' AS variable, count(*) AS rows, count({v}) AS finite, count(*) FILTER (WHERE {v} {op} {low} AND {v} <= {high}) AS in_range,
  {rounded(f"min({v})")} AS least, {rounded(f"max({v})")} AS most FROM x GROUP BY kind"""  # noqa: E731

SQL = {
    "text_classes": f"""WITH p AS (SELECT replace(lower(trim({_LIST(SHIP_TEXTS)}[event_id % {len(SHIP_TEXTS)} + 1])), ' ', '_') AS a,
  replace(replace(lower(trim({_LIST(PHASE_TEXTS)}[event_id % {len(PHASE_TEXTS)} + 1])), '/', '_'), ' ', '_') AS b FROM events)
SELECT {_CLASS("a", standard.SHIP_TYPES)} AS ship_type, {_CLASS("b", standard.PHASES)} AS phase, count(*) AS n FROM p GROUP BY ALL""",
    "utc_parse": """WITH p AS (SELECT event_id, event_id % 6 AS way, date_trunc('second', ts) AS s FROM events),
u AS (SELECT *, CASE way WHEN 0 THEN s WHEN 1 THEN date_trunc('minute', s) WHEN 2 THEN s WHEN 3 THEN s - INTERVAL 8 HOUR WHEN 4 THEN date_trunc('day', s)::TIMESTAMP END AS utc FROM p)
SELECT event_id, utc::TIMESTAMP AS utc, (CASE WHEN way IN (0, 1, 4) THEN utc - INTERVAL 8 HOUR ELSE utc END)::TIMESTAMP AS utc_of_local FROM u""",
    "ship_age": f"""SELECT event_id, {rounded("(epoch_us(ts) - epoch_us((DATE '2020-01-01' - CAST(event_id % 9000 AS INTEGER))::TIMESTAMP)) / 3600000000.0::DOUBLE / 24 / 365.25::DOUBLE")} AS age_years FROM events""",
    "unit_vectors": f"""WITH {TELEMETRY}, z AS (SELECT event_id, angle, CASE event_id % 7 WHEN 0 THEN 1.2::DOUBLE WHEN 1 THEN 1e-7::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS size FROM t),
v AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN sin(radians(angle)) * size END AS s, cos(radians(angle)) * size AS c FROM z),
n AS (SELECT *, sqrt(s * s + c * c) AS norm FROM v), o AS (SELECT *, abs(s) <= 1.000001 AND abs(c) <= 1.000001 AND norm > 1e-6 AND norm <= 1.010001 AS ok FROM n)
SELECT event_id, {rounded("CASE WHEN ok THEN s / norm END")} AS unit_sin, {rounded("CASE WHEN ok THEN c / norm END")} AS unit_cos FROM o""",
    "interaction_features": f"""WITH {SHIPS} SELECT kind, {", ".join(f"{rounded(f'avg({e})', 4)} AS {n}" for n, e in (
        ("speed_sq", "speed * speed"), ("speed_cu", "speed * speed * speed"), ("speed_x_wind", "speed * wind"), ("speed_x_wave", "speed * wave"),
        ("speed_x_draught", "speed * draught"), ("speed_x_trim", "speed * trim"), ("draught_x_trim", "draught * trim")))} FROM x GROUP BY kind""",
    "draught_ends": f"""WITH {SHIPS}, d AS (SELECT kind, draught - trim / 2 AS fore_draught, draught + trim / 2 AS aft_draught, design FROM x),
l AS (SELECT *, least(fore_draught, aft_draught) AS least_draught, least(fore_draught, aft_draught) / design AS least_design_ratio FROM d)
SELECT kind, count(least_draught) AS n, {", ".join(f"{rounded(f'{f}({v})', 5)} AS {k}_{v}" for v in ("fore_draught", "aft_draught", "least_draught", "least_design_ratio") for k, f in (("min", "min"), ("mean", "avg")))} FROM l GROUP BY kind""",
    "trim_status": f"""WITH {SHIPS}, l AS (SELECT *, CASE WHEN length IS NOT NULL THEN least(6.0::DOUBLE, 0.025::DOUBLE * length) ELSE 6.0 END AS most, 0.01::DOUBLE * length AS soft FROM x),
s AS (SELECT *, CASE WHEN length IS NULL OR length <= 0 THEN 'invalid_ship_length' WHEN trim IS NULL THEN 'missing_trim' WHEN abs(trim) <= soft THEN 'normal_le_1pct_length'
  WHEN abs(trim) <= most THEN 'high_1_to_2_5pct_retained' ELSE 'invalid_gt_2_5pct_or_absolute_cap' END AS trim_status, CASE WHEN length > 0 AND abs(trim) <= most THEN trim END AS kept FROM l)
SELECT trim_status, count(*) AS n, count(kept) AS kept, {rounded("max(abs(kept))", 5)} AS most, {rounded("avg(most)", 5)} AS mean_limit FROM s GROUP BY trim_status""",
    "lineage_rows": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_no FROM events",
    "scored_columns": f"""WITH h AS (SELECT unnest({_LIST(HEADERS)}) AS name), p AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9一-龥]', '', 'g') AS n FROM h),
k AS (SELECT name, n, CASE WHEN n LIKE '%lbp%' THEN 50 WHEN n LIKE '%lengthoverall%' OR n LIKE '%loa%' OR n LIKE '%总长%' THEN 40 WHEN n LIKE '%shiplength%' THEN 30 WHEN n LIKE 'length%' OR n LIKE '%length' THEN 20
  WHEN n LIKE '%length%' THEN 10 END AS base FROM p WHERE NOT (n LIKE '%beam%' OR n LIKE '%breadth%' OR n LIKE '%wave%' OR n LIKE '%draught%')),
s AS (SELECT name, base + CASE WHEN n LIKE '%m' OR n LIKE '%meter%' OR n LIKE '%metre%' THEN 2 ELSE 0 END AS score,
  CASE base WHEN 50 THEN 'between_perpendiculars' WHEN 40 THEN 'overall' WHEN 30 THEN 'ship_length' WHEN 20 THEN 'generic' ELSE 'weak' END AS category FROM k WHERE base IS NOT NULL)
SELECT name, score::INTEGER AS score, category, score = max(score) OVER () AND count(*) OVER (PARTITION BY score) = 1 AS chosen FROM s""",
    "missing_rates": f"""WITH {TELEMETRY}, n AS (SELECT count(*) AS rows, count(reading) AS r, count(angle) AS a FROM t),
e AS (SELECT 'event_id' AS "column", true AS present, rows, 0 AS missing FROM n UNION ALL SELECT 'reading', true, rows, rows - r FROM n UNION ALL SELECT 'angle', true, rows, rows - a FROM n UNION ALL SELECT 'salinity', false, rows, rows FROM n)
SELECT "column", present, rows, missing::BIGINT AS missing, {rounded("missing / rows::DOUBLE")} AS missing_share FROM e""",
    "joined_resample": f"""WITH {TELEMETRY}, {_INTERVAL},
s AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS slots, count(reading) AS valid, sum(minutes) AS m, sum(reading * minutes / 60) AS integral FROM i GROUP BY ALL),
st AS (SELECT *, CASE WHEN slots < 2 THEN 'wrong_slot_count' WHEN valid < slots THEN 'invalid_value' WHEN NOT (m BETWEEN 60 AND 1440) THEN 'coverage' ELSE 'complete' END AS status FROM s),
d AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, date_trunc('hour', ts) - INTERVAL 1 MICROSECOND) AS window_start, sum(reading) AS total, count(reading) AS parts FROM t GROUP BY ALL)
SELECT st.user_id, st.window_start::TIMESTAMP AS window_start, status, {rounded("CASE WHEN status = 'complete' THEN integral END", 4)} AS target, {rounded("total", 4)} AS total, parts,
  status = 'complete' AND total IS NOT NULL AS usable FROM st LEFT JOIN d ON st.user_id = d.user_id AND st.window_start = d.window_start""",
    "native_windows": f"""WITH {TELEMETRY}, d AS (SELECT user_id, date_trunc('hour', ts) AS slot, count(*) AS rows, avg(reading) AS v FROM t GROUP BY ALL)
SELECT CASE WHEN v IS NULL THEN 'missing_value' WHEN rows > 1 THEN 'merged' ELSE 'native' END AS status, count(*) AS windows, sum(rows)::BIGINT AS rows, {rounded("sum(v / 6)", 3)} AS target FROM d GROUP BY 1""",
    "clean_program": f"""WITH {TELEMETRY}, g AS (SELECT *, CASE WHEN {gap("lag(ts) OVER w", "ts")} <= 1440 THEN 0 ELSE 1 END AS b FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no, CASE WHEN value / 10 BETWEEN 0 AND 30 THEN value / 10 END AS speed,
  CASE WHEN reading BETWEEN 0 AND 120 THEN reading END AS rd FROM g),
i AS (SELECT *, CASE WHEN ahead > 0 AND ahead <= 720 THEN ahead ELSE 60.0::DOUBLE END AS minutes FROM (SELECT *, {gap("ts", "lead(ts) OVER w")} AS ahead FROM n WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, event_id))),
a AS (SELECT user_id, session_no, time_bucket(INTERVAL 1 DAY, ts) AS d, count(*) AS slots, count(rd) AS valid, sum(minutes) AS m, sum(speed * minutes) / nullif(sum(CASE WHEN speed IS NOT NULL THEN minutes END), 0) AS speed,
  {_CIRC.format(s="sum(sin(radians(angle)))", c="sum(cos(radians(angle)))")} AS course, sum(rd * minutes / 60) AS target FROM i GROUP BY ALL)
SELECT CASE WHEN speed > 8 THEN 'cruise' WHEN speed >= 1 THEN 'maneuver' ELSE 'anchor_berth' END AS phase,
  CASE WHEN slots < 2 THEN 'slots' WHEN valid < slots THEN 'missing_value' WHEN NOT (m BETWEEN 60 AND 1440) THEN 'coverage' WHEN speed IS NULL THEN 'no_speed' ELSE 'kept' END AS outcome,
  count(*) AS windows, {rounded("sum(target)", 3)} AS target, {rounded("avg(course)", 3)} AS mean_course FROM a GROUP BY ALL""",
    "phase_extract": f"""WITH {SHIPS}, p AS (SELECT *, CASE WHEN speed > 12 THEN 'cruise' WHEN speed >= 8 THEN 'maneuver' ELSE 'anchor_berth' END AS phase FROM x),
f AS (SELECT phase, count(*) AS rows, count(*) FILTER (WHERE length IS NOT NULL AND design IS NOT NULL) AS complete, count(DISTINCT l_suppkey) AS entities FROM p GROUP BY phase)
SELECT n.phase, coalesce(rows, 0) AS rows, coalesce(complete, 0) AS complete, coalesce(entities, 0) AS entities FROM (SELECT unnest(['cruise', 'maneuver', 'anchor_berth']) AS phase) n LEFT JOIN f ON f.phase = n.phase""",
    "service_speed_review": f"""WITH {SHIPS}, y AS (SELECT l_suppkey, speed + CASE WHEN l_orderkey % 97 = 0 THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END AS speed FROM x),
q AS (SELECT l_suppkey, quantile_cont(speed, 0.99) AS hq, quantile_cont(speed, 0.75) + 1.5::DOUBLE * (quantile_cont(speed, 0.75) - quantile_cont(speed, 0.25)) AS fence FROM y GROUP BY 1),
j AS (SELECT y.l_suppkey, speed > hq AND speed > fence AS e, speed > 1.5::DOUBLE * (12.0::DOUBLE + y.l_suppkey % 5) AS o FROM y JOIN q ON y.l_suppkey = q.l_suppkey)
SELECT l_suppkey, count(*) AS rows, count(*) FILTER (WHERE e) AS extreme, count(*) FILTER (WHERE o) AS over_service, count(*) FILTER (WHERE e OR o) AS flagged FROM j GROUP BY 1""",
    "trim_report": f"""WITH {SHIPS} SELECT kind, l_suppkey, count(*) AS rows, count(trim) AS finite, count(*) FILTER (WHERE trim < -2) AS below, {rounded("min(trim)")} AS least, {rounded("max(trim)")} AS most,
  {rounded("100 * count(*) FILTER (WHERE trim < -2) / nullif(count(trim), 0)::DOUBLE")} AS below_pct FROM x GROUP BY ALL""",
    "range_recheck": f"WITH {SHIPS} " + " UNION ALL ".join(_AUDIT(*a) for a in (("wave", 0, 2.5, ">"), ("wind", 0, 12, ">="), ("trim", -6, 6, ">="), ("length", 0, 320, ">"))),
    "model_completeness": f"""WITH {SHIPS} SELECT kind, concat_ws('+', CASE WHEN speed IS NULL THEN 'speed' END, CASE WHEN wind IS NULL THEN 'wind' END, CASE WHEN wave IS NULL THEN 'wave' END, CASE WHEN draught IS NULL THEN 'draught' END,
  CASE WHEN trim IS NULL THEN 'trim' END, CASE WHEN length IS NULL THEN 'length' END) AS lacks, count(*) AS n FROM x GROUP BY ALL""",
    "joint_support": f"""WITH {SHIPS}, b AS (SELECT kind, min(speed) AS s0, max(speed) AS s1, min(wave) AS w0, max(wave) AS w1, min(draught) AS d0, max(draught) AS d1 FROM x WHERE l_orderkey % 5 > 0 AND speed >= 9.5 AND wave <= 2.7 GROUP BY kind),
v AS (SELECT x.*, level, speed * (1 - level / 100) AS slow FROM x, (SELECT unnest([5.0::DOUBLE, 10.0::DOUBLE]) AS level) WHERE l_orderkey % 5 = 0),
j AS (SELECT v.kind, level::VARCHAR AS level, coalesce(slow BETWEEN s0 AND s1, false) AS a, coalesce(wave BETWEEN w0 AND w1, false) AS c, coalesce(draught BETWEEN d0 AND d1, false) AS d FROM v LEFT JOIN b ON v.kind = b.kind)
SELECT CASE WHEN grouping(kind) = 1 THEN 'All' ELSE kind END AS kind, CASE WHEN grouping(level) = 1 THEN 'All' ELSE level END AS level, count(*) AS n, {rounded("100 * avg(a::INT::DOUBLE)", 5)} AS in_speed_pct,
  {rounded("100 * avg(c::INT::DOUBLE)", 5)} AS in_wave_pct, {rounded("100 * avg(d::INT::DOUBLE)", 5)} AS in_draught_pct, {rounded("100 * avg((a AND c AND d)::INT::DOUBLE)", 5)} AS joint_pct FROM j GROUP BY CUBE (kind, level)""",
    "threshold_evidence": f"""WITH {SHIPS}, w AS (SELECT kind, {rounded("avg(speed)")} AS value FROM x GROUP BY kind)
SELECT kind, shape, value, value >= 13.1 AS passes FROM w, (SELECT unnest(['long', 'wide']) AS shape)""",
}
