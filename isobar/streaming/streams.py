"""Structured Streaming twins of the batch operators; the column functions are the same."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a table that batch reads too."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def tumbling(stream: DataFrame, ts: str, entity: str, value: str, window: str, late: str) -> DataFrame:
    at = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return at.groupBy(F.window("__ts", window).alias("w"), entity).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(entity, F.col("w.start").alias("window_start"), "n", "total")


def sessions(stream: DataFrame, ts: str, entity: str, value: str, gap: str, late: str) -> DataFrame:
    at = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return at.groupBy(F.session_window("__ts", gap).alias("w"), entity).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(entity, F.col("w.start").alias("session_start"), "n", "total")


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    at = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return at.dropDuplicatesWithinWatermark(keys).drop("__ts")


def jump_sessions(stream: DataFrame, ts: str, entity: str, value: str, gap_minutes: float, most_rate: float) -> DataFrame:
    """Session numbers by gap or by the value's rate of change, with one row of state an entity: last time, value, number."""
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_ts, last_value, number, n = state.get if state.exists else (None, None, 0, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for t, v in zip(rows["ts"].astype("int64") / 60e9, rows["value"], strict=True):
            gap = None if last_ts is None else t - last_ts
            if gap is None or gap > gap_minutes or (gap > 0 and abs(v - last_value) / gap * 60 > most_rate):
                number += 1
            last_ts, last_value, n = t, v, n + 1
        state.update((last_ts, last_value, number, n))
        yield pd.DataFrame({"entity": [key[0]], "sessions": [number], "rows": [n]})

    rows = stream.select(F.col(entity).alias("entity"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).alias("value"))
    return rows.groupBy("entity").applyInPandasWithState(step, "entity long, sessions long, rows long", "last_ts double, last_value double, number long, n long", "update", "NoTimeout")


def drained(stream: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """All that is there now, through the stream and written to `path`, as a table; in update mode the last row of each key."""
    def store(rows: DataFrame, batch: int) -> None:
        rows.withColumn("__batch", F.lit(batch)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={batch}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    found = stream.sparkSession.read.option("recursiveFileLookup", True).schema(stream.withColumn("__batch", F.lit(0)).schema).parquet(f"{path}/rows")
    if mode != "update":
        return found.drop("__batch")
    rest = [c for c in stream.columns if c not in (keys or [])]
    return found.groupBy(*(keys or [])).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*(keys or []), "r.*")
