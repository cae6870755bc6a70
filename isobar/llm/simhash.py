"""SimHash near-dedup by pigeonhole blocks.

A fingerprint has a bit set where over half the XXH64 values of the text's word shingles have it. Texts with equal
fingerprints are one item from the start. Of `blocks` blocks, two fingerprints that differ in at most `distance` bits
agree in blocks - distance of them, so every choice of so many blocks is a join key; pairs that meet on a key are
verified by Hamming distance. A key that more than `most` fingerprints share is not joined with itself: each of them is
linked with the fingerprints one bit away, within the bits outside its shared blocks, and all that touch one such
neighbour are within two bits of each other, so a star for each neighbour finds the same links in linear size
(this way holds for a distance of 2; both ways are exact). Linked fingerprints form components by label propagation.

Null, empty and white texts have fingerprint zero and are linked like any other. Texts of fewer words than a shingle
have one shingle. An empty table gives an empty result. component_id is the smallest id of the component, nulls
aside. Input columns named like an added one are replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, attach, components, cut, discard, own_names, table, without

ADDED = ["fingerprint", "component_id", "component_fp"]


def fingerprint(text: str | None, shingle: int) -> int:
    """As an unsigned number."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.frombuffer(b"".join([xxh64_digest(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str, name: str, shingle: int, keep_text: bool = True) -> DataFrame:
    compute = lambda rows: {name: np.array([fingerprint(t, shingle) for t in rows.column(text_col).to_pylist()], np.uint64).view(np.int64)}
    return add_columns(docs, compute, {name: "long"}, () if keep_text else (text_col,), text_col)


def _masks(blocks: int, distance: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(one, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fingerprints: DataFrame, distance: int = 2, blocks: int = 5, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """(u, v), and the table that it is made from: edges whose components are those of all pairs of fingerprints(fp) within the distance."""
    if distance != 2:
        raise ValueError("keys of many fingerprints are handled for a distance of 2 only")
    masks = _masks(blocks, distance)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    dealt = fingerprints.select("fp", keys.alias("b")).select("fp", "b.k", "b.key")
    shared = dealt.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(attach(dealt, shared, ["k", "key"], "n", fingerprints.count()).filter("n IS NOT NULL"), "simhash-blocks")
    few = met.filter(F.col("n") <= most).select("k", "key", "fp")
    pairs = (
        few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), ["k", "key"])
        .filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")
    )
    free = F.element_at(F.array(*[F.lit(_signed(~m & ((1 << 64) - 1))) for m in masks]), F.col("k") + 1)
    hot = met.filter(F.col("n") > most).groupBy("fp").agg(F.bit_or(free).alias("free"))
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda b: b.bitwiseAND(F.col("free")) != 0)
    near = F.concat(F.array("fp"), F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b)))
    stars = hot.select("fp", F.explode(near).alias("hub"))
    centre = stars.groupBy("hub").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1")
    return pairs.unionByName(stars.join(centre, "hub").filter("fp <> u").select("u", F.col("fp").alias("v")).distinct()), met


@own_names
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 2, keep_text: bool = True) -> DataFrame:
    """All rows and columns of docs with fingerprint (16 hex digits), component_id and component_fp, its smallest fingerprint (signed order)."""
    rows = cut(with_fingerprints(without(docs, ADDED), text_col, "__fp", shingle, keep_text), "simhash-rows")
    each = cut(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "simhash-fps")
    edges, met = links(each.select("fp"), distance)
    found = components(edges, "simhash-cc")
    discard(met)
    named = each.join(found, each.fp == found.node, "left").select("fp", "n", "low", F.coalesce("label", "fp").alias("label"))
    named = cut(named, "simhash-named")
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    of_fp = named.join(least, "label").select(F.col("fp").alias("__fp"), "component_id", F.col("n").alias("__n"), F.lower(F.lpad(F.hex("label"), 16, "0")).alias("component_fp"))
    out = attach(rows, cut(of_fp, "simhash-components"), "__fp", "__n", rows.count())
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("__fp"), 16, "0"))).drop("__fp", "__n")


def one_of_each(docs: DataFrame, found: DataFrame, component: str, id_col: str = "doc_id") -> DataFrame:
    """One row of each component, that of its smallest id, in docs' columns."""
    low = found.filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    one = low.withColumn("__row", F.row_number().over(Window.partitionBy(component, id_col).orderBy(F.lit(0)))).filter("__row = 1")
    return one.select([c for c in docs.columns if c in one.columns])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of near_duplicates."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, **options), "component_fp", id_col)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, keep_text=False).select("doc_id", *ADDED)
