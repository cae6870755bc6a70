"""Readers and writers: sniffed CSV, typed scans, resolved columns, idempotent writes."""

from __future__ import annotations

import hashlib
import tempfile
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c


def normal_name(name: str) -> str:
    """Compatibility form, lower case, letters and digits only."""
    return "".join(x for x in unicodedata.normalize("NFKC", name).lower() if x.isalnum())


def resolved(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """The canonical columns, each from the first alias that is there; absent ones are null doubles."""
    there = {normal_name(x): x for x in reversed(df.columns)}
    picks = []
    for canonical, names in aliases.items():
        found = next((there[normal_name(n)] for n in [canonical, *names] if normal_name(n) in there), None)
        picks.append(F.col(f"`{found}`").alias(canonical) if found else F.lit(None).cast("double").alias(canonical))
    return df.select(picks)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Without one a local session takes a temporary one, and a cluster is refused, as its machines' own folders are not shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='isobar-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder once: what uses it several times reads files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_bytes(spark: SparkSession, path: str, most: int) -> bytes:
    """The first bytes of the first file that is not empty, at most so many, whatever its size."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    files = sorted((str(f.getPath()), f.getLen()) for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    for name, size in files:
        if size:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, most)))
            finally:
                stream.close()
    return b""


def sniffed(spark: SparkSession, path: str, sample: int = 65536) -> tuple[str, str]:
    """(encoding, separator) of a text file, from its first bytes, read through Spark's own file systems."""
    head = first_bytes(spark, path, sample)
    for encoding in ("utf-8", "gb18030"):
        try:
            text = bytes(head).decode(encoding, errors="strict" if len(head) < sample else "ignore")
            break
        except UnicodeDecodeError:
            continue
    else:
        encoding, text = "iso-8859-1", bytes(head).decode("latin-1")
    line = text.splitlines()[0] if text else ""
    return encoding, max(",;\t|", key=lambda s: (line.count(s), -",;\t|".index(s)))


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """All columns as text, then those of `types` cast; what doesn't parse is null."""
    encoding, sep = sniffed(spark, path)
    if encoding == "gb18030":  # Spark's reader takes a few character sets only, unless told to
        spark = spark.newSession()
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("inferSchema", False).csv(path)
    return raw.withColumns({k: c.parse_number(k) if t == "double" else F.col(k).try_cast(t) for k, t in (types or {}).items() if k in raw.columns})


def write_once(df: DataFrame, path: str, force: bool = False, partition_by: list[str] | None = None) -> bool:
    """Writes Parquet unless a whole earlier write is there; Spark's commit leaves no half-written table to be mistaken for one."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not force and hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return False
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return True


def file_lineage(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime and sha256 of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def inferred_csv(spark: SparkSession, path: str, share: float = 0.1) -> DataFrame:
    """All columns with types inferred from a share of the rows; the rest is read by them, and what doesn't fit is null."""
    _, sep = sniffed(spark, path)
    options = {"header": True, "sep": sep}
    schema = spark.read.options(**options, inferSchema=True, samplingRatio=share).csv(path).schema
    return spark.read.options(**options, mode="PERMISSIVE").schema(schema).csv(path)


def write_ordered_csv(df: DataFrame, path: str, order: list[str], sep: str = ",") -> None:
    """CSV files that follow each other in the order: sorted by ranges, each range a file, so no task has all rows."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def append_checked(df: DataFrame, path: str) -> None:
    """Appends to a Parquet table if names and types are those that it has; otherwise an error, and nothing is written."""
    spark = df.sparkSession
    if _exists(spark, path):
        there = spark.read.parquet(path).schema
        if [(f.name, f.dataType) for f in there] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"{path} has {there.simpleString()}, not {df.schema.simpleString()}")
    df.write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def input_signature(spark: SparkSession, paths: list[str]) -> str:
    """A SHA-256 of the names, sizes and times of all files under the paths."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith((".", "_")):
                found.append(f"{f.getPath().getName()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def run_step(spark: SparkSession, path: str, version: str, inputs: list[str], build, force: bool = False) -> tuple[DataFrame, bool]:
    """The step's table and whether it was built now: a table that the same version made from the same inputs is taken as it is.

    The state is written after the table, so that a step which broke off is built again.
    """
    state = [(version, input_signature(spark, inputs))]
    if not force and _exists(spark, f"{path}/state/_SUCCESS") and [tuple(r) for r in spark.read.json(f"{path}/state").select("version", "inputs").collect()] == state:
        return spark.read.parquet(f"{path}/rows"), False
    build().write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame(state, "version string, inputs string").write.mode("overwrite").json(f"{path}/state")
    return spark.read.parquet(f"{path}/rows"), True


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line; Spark's commit leaves no half-written table."""
    df.write.mode("overwrite").json(path)
