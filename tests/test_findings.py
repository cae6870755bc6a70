"""What a review found on larger tables, made small."""

import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from isobar.functions import columns as c
from isobar.operators import ml, series, statistics
from isobar.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture
def conf(spark):
    """Sets a value for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_draws_are_not_broadcast(spark, conf):
    """All draws went through the driver, as rows exploded out of one row count as small."""
    k = spark.range(3000).select(F.col("id").alias("c"), (F.col("id") * 1.0).alias("m"), F.lit(1.0).alias("one"))
    conf("spark.sql.autoBroadcastJoinThreshold", "4096")
    b = statistics.cluster_bootstrap(k, "c", ["m", "one"], 20, F.col("m") / F.col("one"))
    assert "BroadcastExchange" not in plan(b)
    drawn = lambda a, s: int(int(hashlib.md5(f"{a}|{s}".encode()).hexdigest()[:13], 16) / (1 << 52) * 3000)
    assert dict(b.collect()) == {a: sum(drawn(a, s) for s in range(3000)) / 3000 for a in range(20)}
    assert statistics.cluster_bootstrap(k.limit(0), "c", ["m", "one"], 20, F.col("m") / F.col("one")).collect() == []


def test_hashed_bootstrap_broadcasts_no_draws(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "1000")
    b = QUERIES["hashed_bootstrap"](spark, SF)
    assert "BroadcastExchange" not in plan(b)
    assert b.first().draws == 400


def same_as_sql(spark, name, sf=SF):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, found = con.sql(SQL[name]), QUERIES[name](spark, sf)
    rows = lambda x: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in x)
    assert rows(found.select(*want.columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", ["calendar_coverage", "chrono_split", "serial_residuals"])
def test_more_than_64_ranges(spark, conf, name):
    """With so many shuffle partitions the ranges were numbered by a function over an array, whose column joins lost (in small runs,
    only in a session's first)."""
    conf("spark.sql.shuffle.partitions", "100")
    assert "lambdafunction" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    same_as_sql(spark, name)


def test_sector_at_its_edge(spark):
    """The angle of these is 45 degrees in SQL, by the bits that its second remainder rounds off."""
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("event_id", "value")
    made = e.crossJoin(spark.range(6).select(F.col("id").alias("copy"))).withColumn("event_id", F.col("event_id") + F.col("copy") * 100_000)
    made = made.filter(F.col("event_id").isin(67877, 256379, 276763, 300657))
    rel = c.wrap_180(F.pmod(F.col("value") * 7.0, F.lit(360.0)) - (F.col("event_id") * 91 % 3600 / 10.0 - 180.0))
    assert sorted(made.select(rel.alias("x")).toPandas()["x"]) == [-45.0, 45.0, 45.0, 45.0]


def test_quantiles_to_the_last_bit(spark):
    """15.4 to 15.6 at 0.75 is 15.549999999999999 in DuckDB: it rounds once, and rows at a fence follow it."""
    pairs = [(i, 10.4 + i / 10, 10.4 + i / 10 + (i % 7) / 5) for i in range(300)] + [(300, 15.4, 15.6), (301, float("-inf"), 1.0), (302, 26.8, 26.8)]
    df = spark.createDataFrame([(g, x) for g, *both in pairs for x in both], "g long, x double")
    at = [0.0, 0.1, 0.25, 0.3, 0.5, 0.75, 0.99, 1.0]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(g, x) for g, *both in pairs for x in both])
    want = con.sql(f"SELECT g, {', '.join(f'quantile_cont(x, {q})' for q in at)} FROM t GROUP BY g ORDER BY g").fetchall()
    found = series.quantiles(df, ["g"], "x", at).drop("n").orderBy("g").collect()
    assert [tuple(r) for r in found] == want


def test_nearest_far_from_zero_with_copies_and_shared_ids(spark):
    """Over several leaves; squares of such features lose the distances, if taken apart from each other."""
    r = random.Random(6)
    at = lambda: 1e7 + r.randrange(12) / 8
    train = [(i % 350, "ab"[i % 2], at(), at(), at()) for i in range(400)] + [(1000, "a", float("nan"), at(), at()), (1001, "c", at(), at(), at())]
    test = [(i % 90, "abcd"[i % 4], at(), at(), at()) for i in range(100)]
    make = lambda x: spark.createDataFrame(x, "row_id long, kind string, x double, y double, z double")
    for own, asked in ((False, test), (True, train)):
        found = {(q.kind, q.row_id): q.distance for q in ml.nearest_distances(make(asked), make(train), "kind", ["x", "y", "z"], "row_id", 4, own, block=30).collect()}
        assert set(found) == {(kind, i) for i, kind, *_ in asked if kind != "d"}
        for kind, i in found:
            near = [math.dist(p, q) for a, g, *p in asked if (a, g) == (i, kind) for b, h, *q in train if h == kind and not (own and b == i)]
            best = sorted(d for d in near if d == d)[:4]
            if (i, kind) == (1000, "a"):
                assert math.isnan(found[kind, i])
            elif best:
                assert abs(found[kind, i] - sum(best) / len(best)) < 1e-9
            else:
                assert found[kind, i] is None
