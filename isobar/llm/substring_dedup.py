"""Exact substring dedup by induced-sorting suffix arrays over content-routed shards.

A text is handled as its UTF-8 bytes. Each string of `length` bytes has an anchor, the leftmost least of the hashes of
its 32-byte pieces, which depends on the string alone: equal strings, wherever they start, have equal anchors. Neighbouring
strings with one anchor position form a stretch, so every string starts in just one stretch, and a stretch holds no
string twice. Only stretches whose anchor occurs again move on. Those of one anchor go to one shard, equal stretches as
one with their number; the shard's suffix array and permuted common prefixes tell which starts share `length` bytes
with another start. An anchor with more than `most` different stretches is not gathered: its stretches are parted by how far
their strings begin before the anchor, in halves, and go to shards by the bytes that all strings of such a half share,
which equal strings have in common. Halves are parted again until no shard has too many; those of one string each are
alike or apart.

Every byte that a repeated string covers is removed, all copies included; strings are judged on the input. Null is
empty, texts shorter than `length` lose nothing, matches never cross documents. Rows repeated in all of id and text are
copies of each other like any rows. A text of one short period has a stretch for each period. An empty table gives an
empty result. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, attach, bloom_probe, bloom_words, cut, discard, own_names, release, small_batches, table, tidy, without
from .sais import permuted_prefixes, suffix_array

ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
PIECE = 32
#: Random numbers for byte values, and odd multipliers for the doubling of piece lengths, from a fixed seed.
_DRAWN = np.random.default_rng(20240601).integers(0, 1 << 63, 256 + 5, dtype=np.int64).astype(np.uint64)
BYTE, FACTOR = _DRAWN[:256] << np.uint64(1) | np.uint64(1), _DRAWN[256:] | np.uint64(1)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each position that has so many."""
    h = BYTE[data]
    for k in range(5):
        size = 1 << k
        h = h[:-size] * FACTOR[k] + h[size:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    m, size = h, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first start, starts, anchor) of each stretch; texts need length bytes at least to have any."""
    sizes = np.array([len(t) for t in texts], np.int64)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    data = np.frombuffer(b"".join([texts[i] for i in long]), np.uint8)
    h = piece_hashes(data)
    least = least_in(h, length - PIECE + 1)  # for each start in the joined texts; those over a text's end don't count
    base = np.cumsum(sizes[long]) - sizes[long]
    valid = np.zeros(len(least) + 1, np.int8)
    valid[base] = 1
    np.add.at(valid, base + sizes[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    new[base] = True
    first = np.flatnonzero(new & valid)
    end = np.concatenate((first[1:], [len(least)]))
    of = np.searchsorted(base, first, side="right") - 1
    end = np.minimum(end, base[of] + sizes[long][of] - length + 1)
    return long[of], first - base[of], end - first, least[first].view(np.int64)


def _stretch_rows(docs: DataFrame, length: int) -> DataFrame:
    """k1, k2 (of the row), first, starts, anchor, same (a hash of the stretch's bytes)."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            of, first, starts, anchor = stretches(texts, length)
            ends = (first + starts - 1 + length).tolist()
            same = [xxh3_64_intdigest(texts[i][a:b]) for i, a, b in zip(of.tolist(), first.tolist(), ends, strict=True)]
            k1, k2 = (batch.column(i).to_numpy()[of] for i in (0, 1))
            columns = [k1, k2, first.astype(np.int32), starts.astype(np.int32), anchor, np.array(same, np.uint64).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "first", "starts", "anchor", "same"])

    return docs.mapInArrow(run, "k1 long, k2 long, first int, starts int, anchor long, same long")


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each part, which starts have length bytes in common with another start, by a suffix array of all parts."""
    s = np.concatenate([x for p in parts for x in (np.frombuffer(p, np.uint8) + np.uint8(2), np.ones(1, np.uint8))] + [np.zeros(1, np.uint8)])
    order = suffix_array(s.astype(np.int64), 256)
    prefix = permuted_prefixes(s, order, length)
    shared = prefix >= length
    shared[order[:-1]] |= prefix[order[1:]] >= length
    out, at = [], 0
    for p in parts:
        out.append(shared[at : at + len(p) - length + 1])
        at += len(p) + 1
    return out


def with_partners(anchors: list[int], parts: list[bytes], length: int) -> np.ndarray:
    """Which stretches may share a string with another one of their anchor.

    A shared string has half of what it holds beside the anchor's piece, or more, on one side of it; so those bytes, on one
    side at least, are the same in both stretches. Others can't share any.
    """
    from xxhash import xxh3_64_intdigest

    sizes = np.array([len(p) for p in parts], np.int64)
    base, width, side = np.cumsum(sizes) - sizes, length - PIECE + 1, (length - PIECE) // 2
    h = piece_hashes(np.frombuffer(b"".join(parts), np.uint8))
    at = np.concatenate([h[base[i : i + 2000, None] + np.arange(width)].argmin(axis=1) for i in range(0, len(base), 2000)]).tolist()
    seen: dict[tuple, int] = {}
    sides = []
    for a, p, k in zip(anchors, parts, at, strict=True):
        both = []
        if k >= side:
            both.append((a, 0, xxh3_64_intdigest(p[k - side : k])))
        if k + PIECE + side <= len(p):
            both.append((a, 1, xxh3_64_intdigest(p[k + PIECE : k + PIECE + side])))
        for x in both:
            seen[x] = seen.get(x, 0) + 1
        sides.append(both)
    return np.array([any(seen[x] > 1 for x in both) for both in sides])


def _ranges(flags: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.tolist()


def _judged(parts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(anchor, same, found): the repeated starts of each different stretch that has any, as start, end, ...; parts are dealt by anchor and sorted."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, bytes] = {}
        size, last = 0, None

        def done():
            keys = list(held)
            keys = [k for k, x in zip(keys, with_partners([a for a, _ in keys], list(held.values()), length), strict=True) if x]
            found = [(k, _ranges(m)) for k, m in zip(keys, repeated_starts([held[k] for k in keys], length) if keys else (), strict=True)]
            found = [(k, r) for k, r in found if r]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array([r for _, r in found], pa.list_(pa.int32()))],
                ["anchor", "same", "found"],
            )

        for batch in batches:
            for a, s, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if size >= shard_bytes and a != last:
                    yield done()
                    held, size = {}, 0
                if (a, s) not in held:
                    held[a, s] = b
                    size += len(b)
                last = a
        if held:
            yield done()
        tidy()

    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, same long, found array<int>")


def _parted(parts: DataFrame, length: int, width: int) -> DataFrame:
    """(anchor, same, shift, starts, anchor2, same2): the stretches parted by their starts' distances from the anchor, `width` a part."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        names = ["anchor", "same", "shift", "starts", "anchor2", "same2"]
        for batch in batches:
            rows = []
            for anchor, same, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                p = int(piece_hashes(np.frombuffer(data, np.uint8))[: length - PIECE + 1].argmin())
                last = len(data) - length
                for k in range(max(0, p - last) // width, p // width + 1):
                    low, high = max(0, p - (k + 1) * width + 1), min(last, p - k * width)
                    shared = data[p - k * width : p - (k + 1) * width + 1 + length]
                    route = xxh3_64_intdigest(shared + anchor.to_bytes(8, "little", signed=True) + k.to_bytes(4, "little"), width)
                    rows.append((anchor, same, low, high - low + 1, route, xxh3_64_intdigest(data[low : high + length])))
            columns = [np.array(c, np.uint64).view(np.int64) if i > 3 else np.array(c, np.int64 if i < 2 else np.int32) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return parts.select("anchor", "same", "bytes").mapInArrow(run, "anchor long, same long, shift int, starts int, anchor2 long, same2 long")


def _with_bytes(rows: DataFrame, wanted: DataFrame, length: int, name: str) -> DataFrame:
    """(anchor, same, bytes) of wanted(anchor, same, k1, k2, first, starts), from rows(k1, k2, text)."""
    lists = cut(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "same", "first", "starts")).alias("parts")), f"{name}-lists")
    texts = bloom_probe(rows, bloom_words(lists, "k1"), "k1")
    at, size = F.col("p.first") + 1, F.col("p.starts") + length - 1
    each = texts.join(lists, ["k1", "k2"]).select(F.col("text").cast("binary").alias("text"), F.explode("parts").alias("p"))
    return cut(each.select("p.anchor", "p.same", F.substring(F.col("text"), at, size).alias("bytes")), name)


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """A 128-bit key of a row, from its id and text."""
    return [F.xxhash64(F.lit(x), F.col(id_col), F.col(text_col)).alias(n) for x, n in ((1, "k1"), (2, "k2"))]


def _counted_kinds(classes: DataFrame) -> DataFrame:
    """classes(anchor, same, n, one) of anchors with several, with kinds: how many the anchor has."""
    kinds = classes.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    return cut(attach(classes, kinds, "anchor", "kinds", classes.count()).filter("kinds IS NOT NULL").select("anchor", "same", "n", "kinds", "one.*"), "substring-wanted")


def _classes(stretches: DataFrame, n: Column) -> DataFrame:
    one = F.min(F.struct("k1", "k2", "first", "starts")).alias("one")
    return cut(stretches.groupBy("anchor", "same").agg(F.sum(n).alias("n"), one), "substring-each")


def _found(rows: DataFrame, classes: DataFrame, length: int, most: int, shard_bytes: int) -> DataFrame:
    """(anchor, same, n, found): of each class of equal stretches that has any, the ranges of its repeated starts.

    Only classes of hot anchors are parted, round by round; a part knows the class it came from and where in it it begins.
    """
    wanted = _counted_kinds(classes)
    whole = F.array(F.lit(0), F.col("one.starts")).alias("found")
    out = classes.filter("n > 1").select("anchor", "same", whole)
    judging = [wanted.filter(F.col("kinds") <= most)]
    hot, width = wanted.filter(F.col("kinds") > most), 1 << (length - PIECE).bit_length()
    origin = hot.select("anchor", "same", "n", "k1", "k2", "first", F.col("anchor").alias("anchor0"), F.col("same").alias("same0"), F.lit(0).alias("shift0"))
    origins, tables = [], [wanted]
    while width > 1 and hot.head(1):
        width //= 2
        parts = cut(_parted(_with_bytes(rows, hot, length, "substring-hot"), length, width).dropDuplicates(["anchor", "same", "shift"]), "substring-parted")
        pieces = origin.join(parts, ["anchor", "same"]).select(
            F.col("anchor2").alias("anchor"), F.col("same2").alias("same"), "n", "k1", "k2", (F.col("first") + F.col("shift")).alias("first"), "starts", "anchor0", "same0", (F.col("shift0") + F.col("shift")).alias("shift0")
        )
        pieces = cut(pieces, "substring-pieces")
        each = _classes(pieces, F.col("n"))
        wanted = _counted_kinds(each)
        origins.append((pieces, each))
        judging.append(wanted.filter(F.col("kinds") <= most))
        hot = wanted.filter(F.col("kinds") > most)
        origin = pieces.drop("starts").join(hot.select("anchor", "same"), ["anchor", "same"])
        tables.append(wanted)
        discard(parts)
        release(rows.sparkSession)
    every = judging[0]
    for x in judging[1:]:
        every = every.unionByName(x)
    judged = _judged(_with_bytes(rows, every, length, "substring-parts"), length, shard_bytes)
    judged = cut(judged.join(every.filter("n = 1").select("anchor", "same"), ["anchor", "same"]), "substring-judged")
    out = out.unionByName(judged)
    for pieces, each in origins:
        again = each.filter("n > 1").select("anchor", "same", whole).unionByName(judged)
        back = pieces.select("anchor", "same", "anchor0", "same0", "shift0").join(again, ["anchor", "same"])
        out = out.unionByName(back.select(F.col("anchor0").alias("anchor"), F.col("same0").alias("same"), F.transform("found", lambda x: x + F.col("shift0")).alias("found")))
    one = out.filter(F.size("found") > 0).groupBy("anchor", "same").agg(F.flatten(F.collect_list("found")).alias("found"))
    one = cut(classes.select("anchor", "same", "n").join(one, ["anchor", "same"]), "substring-found")
    discard(judged, *tables, *(x for pair in origins for x in pair))
    return one


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int, most: int, shard_bytes: int) -> DataFrame:
    """(k1, k2, spans): the repeated strings' first and end bytes in a row, unmerged."""
    rows = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text"))
    every = cut(_stretch_rows(rows.filter(F.octet_length("text") >= length), length), "substring-stretches")
    again = cut(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "substring-anchors")
    met = cut(attach(every, again, "anchor", "n", every.count()).filter("n IS NOT NULL").drop("n"), "substring-met")
    discard(every, again)
    release(docs.sparkSession)
    classes = _classes(met, F.lit(1))
    found = _found(rows, classes, length, most, shard_bytes)
    shifted = F.transform("found", lambda x, i: x + F.col("first") + F.when(i % 2 == 1, length - 1).otherwise(0)).alias("s")
    spans = attach(met, found, ["anchor", "same"], "n", met.count()).filter("found IS NOT NULL").select("k1", "k2", shifted)
    spans = cut(spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("s")).alias("spans")), "substring-spans")
    discard(met, classes, found)
    return spans


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of first, end, first, end ..."""
    pairs = spans.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1])))
    return pairs[new, 0], reach[np.concatenate((new[1:] - 1, [len(pairs) - 1]))]


def _removed(rows, text_col: str) -> dict:
    out: dict[str, list] = {n: [] for n in [*ADDED, "kept_text"]}
    spans = rows.column("__spans")
    for i, text in enumerate(rows.column(text_col).to_pylist()):
        data, found = (text or "").encode("utf-8", "surrogatepass"), spans[i]
        starts = ends = np.zeros(0, np.int64)
        if found.is_valid and len(found):
            starts, ends = merged(found.values.to_numpy().astype(np.int64))
        kept = b"".join([data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True)])
        for n, v in zip(out, (len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept), strict=True):
            out[n].append(v)
    return out


@own_names
def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, most: int = 1000, shard_bytes: int = 1 << 20, keep_text: bool = True,
) -> DataFrame:
    """All rows and columns of docs with n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept_text (binary: a cut may part a character)."""
    rows = without(docs, [*ADDED, "kept_text"])
    spans = repeated_spans(rows, id_col, text_col, length, most, shard_bytes)
    release(docs.sparkSession)
    keyed = rows.select("*", *[k.alias(f"__{n}") for k, n in zip(row_keys(id_col, text_col), ("k1", "k2"), strict=True)])
    maybe = bloom_probe(keyed, bloom_words(spans, "k1"), "__k1", keep=True)
    listed = spans.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"))
    touched = maybe.filter("__maybe").join(listed, ["__k1", "__k2"], "left")
    free = maybe.filter("NOT __maybe").withColumn("__spans", F.lit(None).cast("array<int>"))
    both = touched.unionByName(free).drop("__k1", "__k2", "__maybe")
    added = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"kept_text": "binary"} if keep_text else {})
    gone = ("__spans", *(() if keep_text else (text_col,)))
    return add_columns(both, lambda r: _removed(r, text_col), added, gone, text_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", *ADDED)
