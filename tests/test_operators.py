"""Edge cases of columns, sources, and stream twins."""

import math

import pytest
from pyspark.sql import functions as F

from isobar.functions import columns as c
from isobar.operators import grid, linkage, ml, quality, scenarios, series, splits
from isobar.sources import tables
from isobar.streaming import streams


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [("1,234.5", 1234.5), ("12 m", 12.0), ("", None), ("x", None), ("１２", None), ("-3e2", -300.0), (None, None), ("1-2", None)])
def test_parse_number(spark, text, want):
    assert one(spark, c.parse_number(F.lit(text).cast("string"))) == want


def test_angles(spark):
    rows = spark.createDataFrame([(359.0,), (1.0,)], "a double")
    assert abs(c_distance(rows.agg(c.circular_mean("a")).first()[0], 0.0)) < 1e-9
    opposite = spark.createDataFrame([(0.0,), (180.0,)], "a double")
    assert opposite.agg(c.circular_mean("a")).first()[0] is None
    assert one(spark, c.wrap_180(F.lit(180.0))) == -180.0 and one(spark, c.wrap_360(F.lit(-1.0))) == 359.0
    assert one(spark, c.finite(F.lit(float("nan")))) is False and one(spark, c.finite(F.lit(None).cast("double"))) is False
    assert one(spark, c.direction_from_uv(F.lit(0.0), F.lit(0.0))) is None


def c_distance(a, b):
    return (a - b + 180) % 360 - 180


def test_haversine(spark):
    quarter = one(spark, c.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert abs(quarter - 3440.065 * math.pi / 2) < 1e-6


def test_weighted_mean_skips_missing(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (3.0, 3.0)], "v double, w double")
    assert rows.agg(c.weighted_mean("v", "w")).first()[0] == 2.5


def test_gap_edges(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1), (1, "2024-01-02 00:00:00", 2), (1, "2024-01-03 00:01:00", 3)], "u int, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.session_no for r in series.gap_sessions(rows, ["u"], "ts", "id", 1440.0).orderBy("id").collect()] == [1, 1, 2]


def test_whole_intervals(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 10.000000000001), (4, 25.0), (5, None)], "id int, m double")
    found = {}
    for r in scenarios.intervals(rows, "m").collect():
        found.setdefault(r.id, []).append(r.interval_minutes)
    assert found == {2: [10.0], 3: [10.0], 4: [10.0, 10.0, 5.0]}


def test_bilinear_is_exact_and_strict(spark):
    cells = spark.range(9).select((F.col("id") / 3).cast("int").alias("i"), (F.col("id") % 3).cast("int").alias("j")).withColumn("f", F.when(F.col("i") + F.col("j") < 4, F.col("i") * 2.0 + F.col("j")))
    points = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.5, 1.5), (3, 9.0, 0.0), (4, 1.0, 2.0)], "id int, lat double, lon double")
    placed = grid.cell(points, "lat", "lon", 0.0, 0.0, 1.0, 3, 3)
    assert {r.id: r.f for r in grid.bilinear(placed, cells, "id", [], "f").collect()} == {1: 1.25, 2: None, 4: 4.0}


def test_linkage_is_one_to_one(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 2), (4, None, 3)], "l int, k string, t int")
    right = spark.createDataFrame([(11, "a", 1), (12, "b", 9), (13, None, 3)], "r int, k string, t int")
    pairs = linkage.tiered(left, right, [("strong", ["k", "t"], "kth"), ("weak", ["t"], "unique")], "l", "r")
    assert {tuple(x) for x in pairs.collect()} == {(1, 11, "strong"), (4, 13, "weak")}


def test_cascade_counts_once(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (9.0,), (12.0,)], "v double")
    rules = [quality.Rule("big", F.col("v") > 10), quality.Rule("odd", F.col("v") > 8), quality.Rule("seen", F.col("v") < 5, "review")]
    assert [tuple(r) for r in quality.cascade_audit(rows, rules).orderBy("step").collect()] == [(1, "big", 4, 1, 3), (2, "odd", 3, 1, 2)]


def test_split_keeps_one_on_either_side(spark):
    rows = spark.createDataFrame([(u, k) for u, n in ((1, 1), (2, 2), (3, 10)) for k in range(n)], "u int, k int")
    found = splits.temporal_cut(rows, ["u"], ["k"]).groupBy("u", "split").count().collect()
    assert {(r[0], r[1], r[2]) for r in found} == {(1, "train", 1), (2, "train", 1), (2, "test", 1), (3, "train", 8), (3, "test", 2)}


def test_sources(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("Ship ID;速度 (kn);x\nA;1,5 kn;1\nB;;2\n".encode("gb18030"))
    assert tables.sniffed(spark, str(path)) == ("gb18030", ";")
    rows = tables.read_csv(spark, str(path), {"x": "int"})
    found = tables.resolved(rows, {"ship_id": ["SHIPID"], "speed": ["速度kn"], "heading": ["hdg"]})
    assert found.columns == ["ship_id", "speed", "heading"] and found.filter("heading IS NULL").count() == 2
    out = str(tmp_path / "out")
    assert tables.write_once(rows, out) and not tables.write_once(rows, out) and tables.write_once(rows, out, force=True)
    assert tables.file_lineage(spark, str(tmp_path), "*.csv").first().sha256


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    live = streams.drained(streams.tumbling(streams.source(spark, path), "ts", "event_type", "value", "1 day", "1 hour"), str(tmp_path / "a"), "complete")
    still = spark.read.parquet(path).groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("window_start")).agg(F.count("*").alias("n"))
    assert {tuple(r)[:3] for r in live.select("event_type", "window_start", "n").collect()} == {tuple(r) for r in still.collect()}
    jumps = streams.drained(streams.jump_sessions(streams.source(spark, path), "ts", "user_id", "value", 1440.0, 1e9), str(tmp_path / "b"), "update", ["entity"])
    batch = series.gap_sessions(spark.read.parquet(path), ["user_id"], "ts", "event_id", 1440.0).groupBy("user_id").agg(F.max("session_no"))
    assert {(r.entity, r.sessions) for r in jumps.collect()} == {tuple(r) for r in batch.collect()}


def test_tile_components_of_a_long_path(spark):
    cells = [(a, b) for a in range(0, 18, 2) for b in range(36)] + [(a, 35 if a % 4 == 1 else 0) for a in range(1, 17, 2)]
    found = grid.tile_components(spark.createDataFrame([*cells, *cells[:9]], "tile_row int, tile_col int")).collect()
    assert len(found) == len(cells) and {r.component for r in found} == {0}


def test_tile_queries_read_all_events(spark):
    from isobar.plans.base import telemetry
    from isobar.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    t = telemetry(spark, sf)
    place = lambda v, low: F.floor((F.col(v) - low) / 10)
    assert QUERIES["tile_components"](spark, sf).agg(F.sum("tiles")).first()[0] == t.select(place("lat", -90), place("lon", -180)).distinct().count()
    tiles = t.selectExpr("event_id * 37 % 18 AS a", "event_id * 91 % 36 AS b").filter("a % 5 > 0").distinct()
    assert QUERIES["box_partition"](spark, sf).agg(F.sum("cells")).first()[0] == tiles.count()


def test_steps_and_sinks(spark, tmp_path):
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    rows.write.parquet(str(tmp_path / "in"))
    step = lambda version, force=False: tables.run_step(spark, str(tmp_path / "step"), version, [str(tmp_path / "in")], lambda: rows.filter("v > 4"), force)
    assert [step("1")[1], step("1")[1], step("2")[1], step("2", True)[1]] == [True, False, True, True]
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    assert step("2")[1] and step("2")[0].count() == 7
    tables.append_checked(rows, str(tmp_path / "out"))
    tables.append_checked(rows, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        tables.append_checked(rows.withColumnRenamed("v", "w"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    tables.write_ordered_csv(rows, str(tmp_path / "csv"), ["id"])
    assert tables.inferred_csv(spark, str(tmp_path / "csv"), 1.0).agg(F.sum("v")).first()[0] == 90


def test_refusing_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (3, 30)], "k int, w int")
    assert linkage.merged(left, right, ["k"], "left", "m:1").count() == 3
    with pytest.raises(ValueError):
        linkage.merged(left, right, ["k"], "left", "1:1")
    pairs = spark.createDataFrame([(1, 10)], "k int, w int")
    assert linkage.linked_enough(right, pairs, "k", 0.5).count() == 1
    with pytest.raises(ValueError):
        linkage.linked_enough(right, pairs, "k")
    assert linkage.without_entities(left, "k", right).count() == 2


def test_ranges_agree_with_plain_windows(spark):
    rows = spark.createDataFrame([(k % 3 if k % 7 else None, float((k * 37) % 50) if k % 11 else None, k) for k in range(400)], "g int, v double, id int")
    found = series.running(rows, ["g"], ["v", "id"], {"n": F.lit(1)}, parts=9).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.g, []).append(((r.v is not None, r.v or 0, r.id), r.n))
    for members in groups.values():
        assert [n for _, n in sorted(members)] == list(range(1, len(members) + 1))
    import statistics as plain

    for r in series.quantiles(rows, ["g"], "v", [0.25, 0.5, 1.0]).collect():
        values = sorted(x.v for x in rows.collect() if x.g == r.g and x.v is not None)
        at = 0.25 * (len(values) - 1)
        low = values[int(at)]
        want = low + (values[min(int(at) + 1, len(values) - 1)] - low) * (at - int(at))
        assert (r.n, r.q2) == (len(values), values[-1]) and abs(r.q0 - want) < 1e-9 and abs(r.q1 - plain.median(values)) < 1e-9
    assert series.quantiles(rows.limit(0), ["g"], "v", [0.5]).count() == 0


def test_nearest_by_brute_force(spark):
    import random

    r = random.Random(4)
    row = lambda i: (i, "ab"[i % 2], float(r.randrange(30)), float(r.randrange(30)))
    train, test = [row(i) for i in range(160)], [row(1000 + i) for i in range(40)]
    make = lambda x: spark.createDataFrame(x, "row_id long, kind string, x double, y double")
    for own, asked in ((False, test), (True, train)):
        found = {q.row_id: q.distance for q in ml.nearest_distances(make(asked), make(train), "kind", ["x", "y"], "row_id", 3, own, block=25).collect()}
        for i, kind, x, y in asked:
            best = sorted(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for j, k, a, b in train if k == kind and not (own and j == i))[:3]
            assert abs(found[i] - sum(best) / 3) < 1e-6
    support = ml.knn_support(make(test), make(train), "kind", ["x", "y"], "row_id", 3, 0.9)
    assert support.count() == 40 and support.filter("supported").count() > 20


def test_balanced_folds_by_hand(spark):
    rows = spark.createDataFrame([("g", e) for e, n in (("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 1)) for _ in range(n)], "g string, e string")
    folds = {r.e: r.fold for r in splits.balanced_folds(rows, ["g"], "e", 2).collect()}
    assert folds == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_linear_models_by_hand(spark):
    import numpy as np

    g = np.random.default_rng(5)
    x = g.normal(size=(240, 2)) * [1.0, 3.0]
    y = 2 + 1.5 * x[:, 0] - 0.3 * x[:, 1] + 0.2 * x[:, 0] ** 2 + g.normal(size=240) * 0.1
    kind = [["a", "b", "c"][i % 3] for i in range(240)]
    rows = spark.createDataFrame([(i, kind[i], float(x[i, 0]), float(x[i, 1]), float(y[i]), i % 4) for i in range(240)], "id long, kind string, u double, v double, y double, fold int")
    fit = lambda a, b: np.linalg.lstsq(np.column_stack([np.ones(len(a)), a]), b, rcond=None)[0]
    said = lambda w, a: np.column_stack([np.ones(len(a)), a]) @ w
    rmse = lambda e: float(np.sqrt(np.mean(e**2)))
    for r in ml.leave_one_out(rows, "kind", "linear", ["u", "v"], "y").collect():
        own = np.array([k == r.kind for k in kind])
        assert abs(r.rmse - rmse(y[own] - said(fit(x[~own], y[~own]), x[own]))) < 1e-5
    test = np.arange(240) % 5 == 0
    split = rows.filter("id % 5 > 0"), rows.filter("id % 5 = 0")
    for r in ml.ablation(*split, "linear", {"first": ["u"], "second": ["v"]}, "y").collect():
        part = x[:, {"none": [0, 1], "first": [1], "second": [0]}[r.dropped]]
        assert abs(r.rmse - rmse(y[test] - said(fit(part[~test], y[~test]), part[test]))) < 1e-5
    for r in ml.polynomial_fits(rows, "u", "y", [1, 2, 3]).collect():
        e = y - np.polyval(np.polyfit(x[:, 0], y, r.degree), x[:, 0])
        assert abs(r.r2 - (1 - (e @ e) / (240 * y.var()))) < 1e-6 and abs(r.aic - (240 * np.log(e @ e / 240) + 2 * (r.degree + 1))) < 1e-3
    for r in ml.ridge_search(rows, ["u", "v"], "y", "fold", [0.0, 0.5]).collect():
        sse = 0.0
        for k in range(4):
            own = np.arange(240) % 4 == k
            a, b = x[~own], y[~own]
            scale, spread = a.std(axis=0, ddof=1), b.std(ddof=1)
            z = (a - a.mean(axis=0)) / scale
            w = np.linalg.solve(z.T @ z / len(z) + r.alpha / spread * np.eye(2), z.T @ (b - b.mean()) / len(z)) / scale
            sse += float(((y[own] - (b.mean() + (x[own] - a.mean(axis=0)) @ w)) ** 2).sum())
        assert abs(r.mse - sse / 240) < (1e-6 if r.alpha == 0 else 0.02 * r.mse)
    own = {(r.kind, r.fit): r.rmse for r in ml.pooled_and_own(*split, "kind", "linear", ["u"], "y").collect()}
    for k in "abc":
        here = np.array([q == k for q in kind])
        assert abs(own[k, "own"] - rmse(y[test & here] - said(fit(x[~test & here][:, :1], y[~test & here]), x[test & here][:, :1]))) < 1e-5
        assert abs(own[k, "pooled"] - rmse(y[test & here] - said(fit(x[~test][:, :1], y[~test]), x[test & here][:, :1]))) < 1e-5


def test_boxes_cover_each_tile_once_within_limits(spark):
    import random

    r = random.Random(1)
    tiles = {(r.randrange(18), r.randrange(36)) for _ in range(90)} | {(5, b) for b in range(30)}
    boxes = grid.box_partition(spark.createDataFrame(sorted(tiles), "tile_row int, tile_col int"), 0.6, 3, 5).collect()
    for x in boxes:
        inside = [t for t in tiles if x.south <= t[0] <= x.north and x.west <= t[1] <= x.east]
        size = (x.north - x.south + 1) * (x.east - x.west + 1)
        assert x.north - x.south < 3 and x.east - x.west < 5 and len(inside) >= x.cells and (x.cells >= 0.6 * size or x.cells == 1)
    assert sum(x.cells for x in boxes) == len(tiles)
