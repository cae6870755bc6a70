"""Shared by the query modules: tables, derived telemetry, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with an angle and a position by arithmetic, and values over 150 as missing."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.when(F.col("value") <= 150, F.col("value")).alias("reading"), F.pmod(F.col("value") * 7.0, F.lit(360.0)).alias("angle"),
        ((F.col("event_id") * 37) % 1200 / 10.0 - 60.0).alias("lat"), ((F.col("event_id") * 91) % 3600 / 10.0 - 180.0).alias("lon"),
    )


#: The same in DuckDB.
TELEMETRY = """t AS (SELECT event_id, ts, user_id, event_type, value, CASE WHEN value <= 150 THEN value END AS reading,
  (value * 7.0) % 360.0 AS angle, ((event_id * 37) % 1200) / 10.0::DOUBLE - 60.0 AS lat, ((event_id * 91) % 3600) / 10.0::DOUBLE - 180.0 AS lon FROM events)"""


def gap(a: str, b: str) -> str:
    """Minutes from a to b in DuckDB."""
    return f"((epoch_us({b}) - epoch_us({a})) / 60000000.0::DOUBLE)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2"
    return f"(2 * 3440.065 * asin(sqrt(least(1.0, greatest(0.0, {a})))))"


def rounded(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"
