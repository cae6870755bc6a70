"""Exact dedup: two-pass Bloom filtering, DataFrame operations only.

Pass 1 hashes every text into one slot of a filter that is spread over the cluster, 16 slots a row or more: what is shuffled
is a slot number a row, combined before. Slots that are hit twice are folded into the bits of the filter that pass 2
probes: about 16 bits for each, in chunks of 64 words, `most_words` words in all at most (64 MB), which bounds the
broadcast. A row whose bit is clear has a unique text and passes straight through. Only the other rows are shuffled, by the
SHA-256 of their text, where false positives fall out; beyond the bound more rows take that way, and results stay the same.

Null text counts as empty. Texts are equal when identical after lower-casing A-Z. The row with the largest id stays
(a null id is smaller than any other); of repeated rows with that id exactly one stays. An empty table gives an empty
result. Input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, attach, cut, own_names, table, without

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]
MOST_WORDS = 1 << 23
CHUNK = 64


def _slot(slots: int):
    return F.pmod(F.xxhash64("text_sha256"), F.lit(slots))


def repeated_slots(hashes: DataFrame, slots: int) -> DataFrame:
    """The slots that two or more rows hit."""
    return hashes.groupBy(_slot(slots).alias("slot")).count().filter("count > 1").select("slot")


def filter_chunks(repeated: DataFrame, words: int) -> DataFrame:
    """(__chunk, __bits): the slots folded into so many words, 64 words an array; at most words / 64 rows."""
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    word = repeated.groupBy(F.pmod(F.shiftright("slot", 6), F.lit(words)).alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = F.map_from_entries(F.collect_list(F.struct((F.col("word") % CHUNK).cast("int").alias("at"), "bits")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long")))
    return word.groupBy(F.floor(F.col("word") / CHUNK).alias("__chunk")).agg(held.alias("held")).select("__chunk", dense.alias("__bits"))


def _probed(rows: DataFrame, chunks: DataFrame, slots: int, words: int) -> DataFrame:
    """rows with __maybe: whether the filter has the row's slot."""
    at = rows.withColumn("__slot", _slot(slots))
    word = F.pmod(F.shiftright("__slot", 6), F.lit(words))
    hit = at.join(F.broadcast(chunks.withColumnRenamed("__chunk", "__c")), F.floor(word / CHUNK) == F.col("__c"), "left")
    bits = F.element_at("__bits", (word % CHUNK).cast("int") + 1)
    maybe = F.coalesce(F.call_function("shiftright", bits, F.col("__slot").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return hit.withColumn("__maybe", maybe).drop("__c", "__bits", "__slot")


@own_names
def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """All rows and columns of docs with keep_id, group_size, kept and text_sha256."""
    rows = without(docs, ADDED).withColumn("text_sha256", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))
    hashes = cut(rows.select(F.col(id_col).alias("__id"), "text_sha256"), "dedup-hashes")
    n_rows = hashes.count()
    slots = max(1 << 10, 1 << (16 * n_rows).bit_length())
    repeated = cut(repeated_slots(hashes, slots), "dedup-slots")
    words = min(most_words, max(1 << 10, 1 << (repeated.count() // 4).bit_length()))
    chunks = cut(filter_chunks(repeated, words), "dedup-filter")
    by_id = _probed(hashes, chunks, slots, words).filter("__maybe").groupBy("text_sha256", "__id").count()
    groups = cut(
        by_id.groupBy("text_sha256").agg(
            F.max_by("__id", F.struct(F.col("__id").isNotNull(), "__id")).alias("keep_id"), F.sum("count").alias("group_size")
        ).filter("group_size > 1"),
        "dedup-groups",
    )
    probed = _probed(rows, chunks, slots, words)
    passing = probed.filter("NOT __maybe").withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    own = F.col(id_col).eqNullSafe(F.col("keep_id"))
    once = F.row_number().over(Window.partitionBy("text_sha256", id_col).orderBy(F.lit(0)))
    met = (
        attach(probed.filter("__maybe"), groups, "text_sha256", "group_size", n_rows)
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        .withColumn("kept", own & (once == 1))
    )
    return passing.unionByName(met).drop("__maybe")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, in docs' columns."""
    marked = mark_duplicates(docs, id_col, text_col)
    return marked.filter("kept").select([c for c in docs.columns if c in marked.columns])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *ADDED)


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
