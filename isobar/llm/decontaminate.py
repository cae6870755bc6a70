"""Benchmark decontamination by training suffix arrays.

Each shard of documents becomes one array of word numbers. Only stretches of benchmark words can match, and only
benchmark stretches of the shard's words, so the shard's suffix array holds the suffixes inside such stretches; nothing
else could be found by any search. Both sides are ranked together by doubling, which orders the training suffixes and
makes any two suffixes comparable in one step. Every benchmark suffix is then looked up in the shard's suffix array by
binary search, all suffixes at once: its neighbours there give its longest verbatim match and where that lies. A window
is 13 consecutive words of an item, or all of a shorter item. Where a suffix's longest match covers its window, the range
of the array that begins with the window gives all occurrences. A document word inside any is hit; a document is
contaminated when at least one in 20 of its words is hit.

The benchmark is the stated query set. It is prepared in blocks of at most `block_bytes` of text (one item at least), those
of whole and of short items apart, and stored in the shared folder; a worker holds one block at a time, and a block takes
memory in proportion to its words. Documents are never shuffled. Null has no words; an item without words has no windows.
An item whose id is null hits words and is counted (once, however many there are), but has no name in items_sha256. An
empty benchmark or table gives no hits or no rows. Repeated rows are judged alike. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import pickle
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, opened, own_names, scratch, small_batches, table, without

ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
WINDOW = 13
#: Bytes to words: A-Z in lower case; all other ASCII but 0-9 and a-z parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def left_to_end(text: np.ndarray) -> np.ndarray:
    """How many words follow from each place on before the next 0; text ends with a 0."""
    zero = np.flatnonzero(text == 0)
    return zero[np.searchsorted(zero, np.arange(len(text)))] - np.arange(len(text))


class Block:
    """Benchmark items as one array of word numbers with a 0 after each, and at each place the item and its window's length."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        number = self.vocab.setdefault
        self.names = [i for i, _ in items]
        self.text = np.array([x for _, w in items for x in (*(number(v, len(self.vocab) + 1) for v in w), 0)] or [0], np.int32)
        size = np.array([len(w) for _, w in items], np.int64)
        self.item = np.repeat(np.arange(len(items)), size + 1) if items else np.zeros(1, np.int64)
        first = np.cumsum(size + 1) - size - 1
        self.at = np.arange(len(self.text)) - (first[self.item] if items else 0)
        full = np.minimum(size, window)[self.item] if items else np.zeros(1, np.int64)
        self.whole = np.where((full > 0) & (left_to_end(self.text) >= full), full, 0)
        self.least = int(np.minimum(size, window).min(initial=window))


def stretches(ids: np.ndarray, least: int) -> np.ndarray:
    """The places of the stretches of at least so many words, each with the place after it; ids end with a 0."""
    known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
    begin, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long = end - begin >= max(1, least)
    begin, size = begin[long], (end - begin)[long] + 1
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)


class Joint:
    """The suffixes of a shard and of a block that may match, ranked together."""

    def __init__(self, docs: list[list[bytes]], block: Block, least: int):
        lengths = np.array([len(d) for d in docs], np.int64)
        get = block.vocab.get
        ids = np.fromiter((x for d in docs for x in (*map(get, d, repeat(0)), 0)), np.int32, int(lengths.sum()) + len(docs))
        source = stretches(ids, least)
        mine = ids[source]
        mine[np.flatnonzero(np.diff(source, append=-1) != 1)] = 0
        first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.doc = np.searchsorted(first, source, side="right") - 1
        self.place = source - first[self.doc] if len(source) else source
        there = np.zeros(len(block.vocab) + 1, bool)
        there[mine] = True
        self.theirs = stretches(np.where(there[block.text], block.text, 0), least)
        asked = np.where(there[block.text], block.text, 0)[self.theirs]
        self.n = len(mine)
        text = np.concatenate((mine, asked, np.zeros(1, np.int32)))
        self.room = left_to_end(text)
        self.levels = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
        size, depth = 1, int(self.room.max())
        while size < depth:
            rank = self.levels[-1]
            ahead = np.concatenate((rank[size:], np.zeros(min(size, len(rank)), np.int64)))
            self.levels.append(np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64))
            size *= 2
        starts = np.flatnonzero(mine > 0)
        self.order = starts[np.argsort(self.levels[-1][starts], kind="stable")]  # the shard's suffix array

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and b have in common."""
        last = len(self.room) - 1
        out, room = np.zeros(len(a), np.int64), np.minimum(self.room[a], self.room[b])
        for k in range(len(self.levels) - 1, -1, -1):
            out += np.where(self.levels[k][np.minimum(a + out, last)] == self.levels[k][np.minimum(b + out, last)], 1 << k, 0)
        return np.minimum(out, room)

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each of the block's places in `theirs`, the length of its longest match, and a place in the shard that has it."""
        asked = self.n + np.arange(len(self.theirs))
        best, where = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        if not len(self.order):
            return best, where
        spot = np.searchsorted(self.levels[-1][self.order], self.levels[-1][asked])
        for side in (spot - 1, spot):
            at = self.order[np.clip(side, 0, len(self.order) - 1)]
            length = np.where((side >= 0) & (side < len(self.order)), self.common(at, asked), 0)
            where, best = np.where(length > best, at, where), np.maximum(best, length)
        return best, where

    def beginning(self, length: int) -> np.ndarray:
        """The rank of each suffix by its first `length` words, in the suffixes' order."""
        out, at = np.zeros(len(self.room), np.int64), np.arange(len(self.room))
        for k in range(len(self.levels) - 1, -1, -1):
            if length >> k & 1:
                part = self.levels[k][np.minimum(at, len(at) - 1)]
                out, at = np.unique(out * (int(part.max()) + 1) + part, return_inverse=True)[1].astype(np.int64), at + (1 << k)
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each is of."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of], of


def occurrences(docs: list[list[bytes]], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, window length, item) of each occurrence of a window."""
    joint = Joint(docs, block, block.least)
    best, _ = joint.longest()
    whole = block.whole[joint.theirs]
    parts = []
    for length in np.unique(whole[(whole > 0) & (best >= whole)]).tolist():
        asked = np.flatnonzero((whole == length) & (best >= length))
        mine = joint.order[joint.room[joint.order] >= length]
        rank = joint.beginning(length)
        found = [np.searchsorted(rank[mine], rank[joint.n + asked], side=s) for s in ("left", "right")]
        at, of = _ranges(*found)
        parts.append((joint.doc[mine[at]], joint.place[mine[at]], np.full(len(at), length), block.item[joint.theirs[asked[of]]]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]).astype(np.int64) for x in zip(*parts, strict=True)) if parts else (none, none, none, none)


def longest(docs: list[list[bytes]], block: Block, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the block, length, document, place) of the longest match of each benchmark suffix that has one of at least so many words."""
    joint = Joint(docs, block, least)
    best, where = joint.longest()
    k = np.flatnonzero(best >= max(1, least))
    return joint.theirs[k], best[k], joint.doc[where[k]], joint.place[where[k]]


def stored_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[str]:
    """Files of the benchmark's blocks in the shared folder, made one at a time; short and whole items apart."""
    folder = scratch(benchmark.sparkSession, "benchmark-blocks")
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    held: dict[bool, list] = {False: [], True: []}
    size, out = {False: 0, True: 0}, []

    def store(short: bool) -> None:
        if held[short]:
            with fs.open_output_stream(f"{path}/{len(out)}") as f:
                f.write(pickle.dumps(Block(held[short])))
            out.append(f"{folder}/{len(out)}")
            held[short], size[short] = [], 0

    for row in benchmark.select(item_col, text_col).toLocalIterator():
        words = words_of(row[1])
        if words:
            short = len(words) < WINDOW
            held[short].append((None if row[0] is None else str(row[0]), words))
            size[short] += len(row[1])
            if size[short] >= block_bytes:
                store(short)
    store(False)
    store(True)
    return out


_BLOCKS: dict[str, Block] = {}


def _block(path: str) -> Block:
    """A stored block; this worker keeps the last two, which are all blocks of a benchmark of usual size."""
    if path not in _BLOCKS:
        while len(_BLOCKS) > 1:
            del _BLOCKS[next(iter(_BLOCKS))]
        fs, name = opened(path)
        with fs.open_input_stream(name) as f:
            _BLOCKS[path] = pickle.loads(f.read())
    return _BLOCKS[path]


def _union(doc: np.ndarray, place: np.ndarray, length: np.ndarray, n_words: np.ndarray) -> dict[int, list[int]]:
    """By document, the stretches of hit words as start, end, start, end ..."""
    base = np.concatenate(([0], np.cumsum(n_words + 1)))
    step = np.zeros(base[-1] + 1, np.int64)
    np.add.at(step, base[doc] + place, 1)
    np.add.at(step, base[doc] + place + length, -1)
    hit = np.concatenate(([0], (np.cumsum(step) > 0).astype(np.int8)))
    edge = np.flatnonzero(np.diff(hit))
    of = np.searchsorted(base, edge[::2], side="right") - 1
    out: dict[int, list[int]] = {}
    for k, a, b in zip(of.tolist(), (edge[::2] - base[of]).tolist(), (edge[1::2] - base[of]).tolist(), strict=True):
        out.setdefault(k, []).extend((a, b))
    return out


def _searched(rows, paths: list[str], text_col: str) -> dict:
    """n_words, hit_spans and hit_items of a shard."""
    docs = [words_of(t) for t in rows.column(text_col).to_pylist()]
    n_words = np.array([len(d) for d in docs], np.int64)
    names: dict[int, set[str | None]] = {}
    none = np.zeros(0, np.int64)
    doc, place, length = [none], [none], [none]
    for path in paths:
        block = _block(path)
        *found, item = occurrences(docs, block)
        for x, part in zip((doc, place, length), found, strict=True):
            x.append(part)
        for k in np.unique(found[0] * len(block.names) + item).tolist():
            names.setdefault(k // len(block.names), set()).add(block.names[k % len(block.names)])
    spans = _union(*(np.concatenate(x) for x in (doc, place, length)), n_words)
    in_order = lambda k: sorted(names.get(k, ()), key=lambda x: (x is not None, x or ""))
    return {"n_words": n_words, "hit_spans": [spans.get(k, []) for k in range(len(docs))], "hit_items": [in_order(k) for k in range(len(docs))]}


@own_names
def mark_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_bytes: int = 8 << 20, shard_bytes: int = 4 << 20, keep_text: bool = True,
) -> DataFrame:
    """All rows and columns of docs with n_words, n_hit, n_items, items_sha256, contaminated, hit_items, and hit_spans: word offsets start, end, ..."""
    found = {"n_words": "long", "hit_spans": "array<long>", "hit_items": "array<string>"}
    paths = stored_blocks(benchmark, item_col, item_text_col, block_bytes)
    out = add_columns(without(docs, [*ADDED, *found]), lambda rows: _searched(rows, paths, text_col), found, () if keep_text else (text_col,), text_col, shard_bytes)
    length = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.withColumns(
        {"n_hit": length, "n_items": F.size("hit_items").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256)}
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """(item_id, item_word, length, doc_id, doc_word): the longest match of each benchmark suffix of at least so many words, over all shards."""
    small_batches(docs.sparkSession)
    paths = stored_blocks(benchmark, "item_id", "text", block_bytes)

    def search(batches):
        import pyarrow as pa

        for rows in batches:
            ids, words = rows.column(0).to_numpy(), [words_of(t) for t in rows.column(1).to_pylist()]
            for path in paths:
                b = _block(path)
                at, length, doc, place = longest(words, b, least)
                columns = [pa.array([b.names[i] for i in b.item[at]], pa.string()), *(pa.array(x, pa.int64()) for x in (b.at[at], length, ids[doc], place))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "item_word", "length", "doc_id", "doc_word"])

    schema = "item_id string, item_word long, length long, doc_id long, doc_word long"
    every = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL").mapInArrow(search, schema)
    best = F.max_by(F.struct("length", "doc_id", "doc_word"), F.struct(F.col("length"), -F.col("doc_id"), -F.col("doc_word")))
    return every.groupBy("item_id", "item_word").agg(best.alias("m")).select("item_id", "item_word", "m.length", "m.doc_id", "m.doc_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, in docs' columns."""
    marked = mark_contaminated(docs, benchmark)
    return marked.filter("NOT contaminated").select([c for c in docs.columns if c in marked.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contaminated(docs, table(spark, sf_dir, "benchmark"), keep_text=False).select("doc_id", *ADDED)
