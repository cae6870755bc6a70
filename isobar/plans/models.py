"""Queries on models and streams; checked by their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import grid, ml
from ..sources import tables
from ..streaming import streams
from .base import r, table

FEATURES = ["quantity", "size", "discount", "tax"]


def _rows(spark, sf):
    x, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = x.join(p, x.l_partkey == p.p_partkey)
    rows = j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("quantity"),
        F.col("p_size").cast("double").alias("size"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_extendedprice") / 1000).alias("price"),
    )
    return tables.written(rows, "model-rows")  # joined once, however many models are fitted


def _halves(spark, sf):
    rows = _rows(spark, sf)
    return rows.filter("pmod(row_id, 5) > 0"), rows.filter("pmod(row_id, 5) = 0")


def _named(df, *keys):
    return df.select(*keys, "n", *[r(k).alias(k) for k in ("rmse", "mae", "r2")])


def regressors(spark, sf):
    return _named(ml.compared(*_halves(spark, sf), ["linear", "ridge", "tree", "forest", "boosted"], FEATURES, "price"), "model")


def ablation(spark, sf):
    groups = {"amount": ["quantity"], "item": ["size"], "terms": ["discount", "tax"]}
    return _named(ml.ablation(*_halves(spark, sf), "linear", groups, "price"), "dropped")


def leave_one_out(spark, sf):
    return _named(ml.leave_one_out(_rows(spark, sf), "kind", "linear", FEATURES, "price"), "kind")


def partial_dependence(spark, sf):
    train, test = _halves(spark, sf)
    return ml.partial_dependence(ml.regressor("tree", FEATURES, "price").fit(train), test, "quantity", [float(x) for x in range(5, 50, 5)])


def permutation_importance(spark, sf):
    train, test = _halves(spark, sf)
    return ml.permutation_importance(ml.regressor("linear", FEATURES, "price").fit(train), test, FEATURES, "price", "row_id")


def ridge_search(spark, sf):
    rows = _rows(spark, sf).withColumn("fold", F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int"))
    return ml.ridge_search(rows, FEATURES, "price", "fold", [0.0, 0.1, 1.0]).select("alpha", r("mse").alias("mse"))


def polynomial_fits(spark, sf):
    return ml.polynomial_fits(_rows(spark, sf), "quantity", "price", [1, 2, 3])


def knn_support(spark, sf):
    """The test rows' distances to all training rows of their kind."""
    train, test = _halves(spark, sf)
    return ml.knn_support(test, train, "kind", FEATURES, "row_id", 5, 0.95)


def box_partition(spark, sf):
    t = table(spark, sf, "events")
    tiles = t.select(((F.col("event_id") * 37) % 18).cast("int").alias("tile_row"), ((F.col("event_id") * 91) % 36).cast("int").alias("tile_col"))
    return grid.box_partition(tiles.filter("tile_row % 5 > 0"), 0.6, 4, 6)


def _drained(stream, mode="append"):
    return streams.drained(stream, f"{tables.shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}", mode, ["entity"])


def stream_tumbling(spark, sf):
    return _drained(streams.tumbling(streams.source(spark, f"{sf}/events.parquet"), "ts", "event_type", "value", "1 day", "1 hour"), "complete").select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", r("total", 4).alias("total"))


def stream_sessions(spark, sf):
    return _drained(streams.sessions(streams.source(spark, f"{sf}/events.parquet"), "ts", "user_id", "value", "12 hours", "1 hour"), "complete").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n", r("total", 4).alias("total"))


def stream_dedup(spark, sf):
    return _drained(streams.deduplicated(streams.source(spark, f"{sf}/events.parquet"), "ts", ["user_id", "event_type"], "1 minute"))


def stream_jump_state(spark, sf):
    return _drained(streams.jump_sessions(streams.source(spark, f"{sf}/events.parquet"), "ts", "user_id", "value", 1440.0, 500.0), "update")


QUERIES = {f.__name__: f for f in (
    regressors, ablation, leave_one_out, partial_dependence, permutation_importance, ridge_search, polynomial_fits, knn_support, box_partition, stream_tumbling, stream_sessions, stream_dedup, stream_jump_state,
)}

SQL = {
    "tile_components": """WITH RECURSIVE t AS (SELECT DISTINCT floor((((event_id * 37) % 1200) / 10.0::DOUBLE - 60.0 + 90) / 10)::INT AS a, floor((((event_id * 91) % 3600) / 10.0::DOUBLE - 180.0 + 180) / 10)::INT AS b FROM events),
      r AS (SELECT a, b, a * 1000 + b AS origin FROM t UNION SELECT t.a, t.b, r.origin FROM r JOIN t ON abs(t.a - r.a) <= 1 AND abs(t.b - r.b) <= 1)
      SELECT component, count(*) AS tiles FROM (SELECT a, b, min(origin)::INTEGER AS component FROM r GROUP BY a, b) GROUP BY component""",
    "stream_tumbling": "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM n GROUP BY user_id, s""",
    "stream_jump_state": """WITH g AS (SELECT user_id, value, lag(value) OVER w AS v, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0::DOUBLE AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
      SELECT user_id AS entity, (count(*) FILTER (WHERE gap IS NULL OR gap > 1440 OR (gap > 0 AND abs(value - v) / gap * 60 > 500)))::BIGINT AS sessions, count(*) AS rows FROM g GROUP BY 1""",
}
