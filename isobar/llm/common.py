"""Shared helpers of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Without one a local session takes a temporary one, and a cluster is refused, as its machines' own folders are not shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='isobar-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def opened(path: str):
    """(Arrow file system, path on it) of a path in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows starts from files that outlive any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables from cut, when all that was derived from them has been written as well."""
    for df in tables:
        drop_path(df.sparkSession, df.cut_path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that an operator is about to add; the operator's own columns win."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def own_names(operator):
    """An operator on rows whose columns may have any name: those that begin like internal ones (__) are set aside."""
    from functools import wraps

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        aside = {c: f"aside {c}" for c in docs.columns if c.startswith("__")}
        out = operator(docs.withColumnsRenamed(aside), *args, **options)
        return out.withColumnsRenamed({v: k for k, v in aside.items()})

    return run


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, n_rows: int, most: int = 10_000) -> DataFrame:
    """Left-joins groups (one row per key, `size` rows of `rows` each) to rows.

    Groups of at least n_rows / most rows number at most `most`: they are broadcast, so that a group
    with a third of all rows is never gathered in one task. All others meet in a shuffled join.
    """
    hot = F.col(size) >= max(1000, -(-n_rows // most))
    by = [key] if isinstance(key, str) else key
    large = F.broadcast(groups.filter(hot))
    rest = rows.join(F.broadcast(groups.filter(hot).select(by)), by, "left_anti")
    return rows.join(large, by).unionByName(rest.join(groups.filter(~hot), by, "left"))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, spread: str, chunks: Column) -> DataFrame:
    """Adds `name`: gapless numbers from 0 within each value of `by`, without gathering a value in one task.

    Rows are dealt to `chunks` (a number for each value of `by`) by a hash of the column `spread`; each chunk is numbered
    alone and starts where those before it end.
    """
    from pyspark.sql import Window

    dealt = rows.withColumn("__chunk", F.pmod(F.xxhash64(F.col(spread)), chunks.cast("long")).cast("int"))
    sizes = dealt.groupBy(*by, "__chunk").count()
    starts = sizes.select(
        *by, "__chunk", (F.sum("count").over(Window.partitionBy(*by).orderBy("__chunk")) - F.col("count")).alias("__start")
    )
    within = F.row_number().over(Window.partitionBy(*by, "__chunk").orderBy(*order))
    return (
        dealt.withColumn("__row", within).join(starts, [*by, "__chunk"])
        .withColumn(name, F.col("__start") + F.col("__row") - 1).drop("__chunk", "__start", "__row")
    )


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small when texts are long, and workers that find this package where it lies."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node that each node of edges(u, v) is linked with.

    Each round points every node to its smallest neighbour or itself, follows the pointers to their ends, and replaces
    nodes by these, so that edges within a group fall away and later rounds have few. Tables are written to the shared
    folder; minima are combined before any shuffle.
    """
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    renamed = lambda df: df.select(F.col("node").alias("label"), F.col("label").alias("far"))
    left = cut(edges.select(*pair).filter("u < v").distinct(), f"{name}-edges")
    files = max(8, left.count() // 100_000 + 1)  # all later tables are smaller than the edges
    few = lambda df: df.coalesce(files)
    found = None
    while left.head(1):
        ends = left.select(F.col("u").alias("node"), F.col("u").alias("label")).unionByName(left.select(F.col("v").alias("node"), F.col("u").alias("label")))
        point = cut(few(ends.groupBy("node").agg(F.min("label").alias("label"))), f"{name}-points")
        while True:
            moved = (F.col("far") != F.col("label")).alias("moved")
            after = cut(few(point.join(renamed(point), "label").select("node", F.col("far").alias("label"), moved)), f"{name}-points")
            discard(point)
            point = after
            if not point.filter("moved").head(1):
                break
        as_u, as_v = (point.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in ("u", "v"))
        kept = left.join(as_u, "u").join(as_v, "v").filter("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
        fewer = cut(few(kept.select(*pair).distinct()), f"{name}-edges")
        discard(left)
        left = fewer
        if found is None:
            found = point
        else:
            named = cut(few(found.join(renamed(point), "label", "left").select("node", F.coalesce("far", "label").alias("label"))), f"{name}-labels")
            discard(found, point)
            found = named
    if found is None:
        found = left.select(F.col("u").alias("node"), F.col("v").alias("label"))
        found.cut_path = left.cut_path
        return found
    discard(left)
    out = found.select("node", "label")
    out.cut_path = found.cut_path
    return out


def add_columns(docs: DataFrame, compute, added: dict[str, str], drop: tuple[str, ...] = (), text_col: str = "text", least_bytes: int = 0) -> DataFrame:
    """docs, less `drop`, with the columns `added` (name: SQL type) that compute(pyarrow table) gives as {name: values}.

    Other columns pass as Arrow data, untouched. Batches are put together until their texts have least_bytes.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    new = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in added.items()))
    kept = [f for f in docs.schema.fields if f.name not in drop]
    schema = StructType(kept + new.fields)
    types = to_arrow_schema(new)

    def run(batches):
        for rows in gathered(batches, text_col, least_bytes):
            values = compute(rows)
            rows = rows.select([f.name for f in kept])
            for f in types:
                v = values[f.name]
                rows = rows.append_column(f.name, v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type))
            yield from rows.combine_chunks().to_batches()
        tidy()

    return docs.mapInArrow(run, schema)


def tidy() -> None:
    """Gives a worker's unused memory back to the system; workers are used again by later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library


def gathered(batches, text_col: str, least_bytes: int):
    """Tables of Arrow batches put together until their texts have least_bytes; none is empty."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(text_col)).nbytes
        if held and size >= least_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


BLOOM_WORDS = 1 << 19


def bloom_words(keys: DataFrame, key: str, words: int = BLOOM_WORDS) -> DataFrame:
    """(word, bits) of a Bloom filter of hashed keys: at most `words` rows, whatever the number of keys."""
    at = keys.select(F.pmod(F.col(key), F.lit(words * 64)).alias("slot"))
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    return at.groupBy(F.shiftright("slot", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def bloom_probe(rows: DataFrame, filter_words: DataFrame, key: str, words: int = BLOOM_WORDS, keep: bool = False) -> DataFrame:
    """The rows whose key may be in the filter; with keep all rows and __maybe. No row is moved."""
    slot = F.pmod(F.col(key), F.lit(words * 64))
    hit = rows.join(F.broadcast(filter_words), F.shiftright(slot, 6) == F.col("__word"), "left")
    maybe = F.coalesce(F.col("__bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))) != 0, F.lit(False))
    hit = hit.withColumn("__maybe", maybe).drop("__word", "__bits")
    return hit if keep else hit.filter("__maybe").drop("__maybe")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps that are written out by now."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
