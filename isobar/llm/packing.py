"""Best-fit packing by best-two-fit, planned on the table of lengths.

Documents are cut into pieces of at most `capacity` ids. How many pieces there are of each length, at most `capacity`
numbers, decides the plan: a sequence is filled greedily, the longest piece that fits first; then its smallest piece
gives way to two unpacked pieces if they fit its expanded gap more tightly. A filling is repeated as long as its pieces
last, so the plan is as large as the number of different fillings, not of documents. Pieces of one length are numbered
across the cluster, and a piece's number tells its sequence and place; nothing is shuffled but small piece rows.

Null and empty texts are one piece, the end id alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, cut, gathered, numbered, small_batches, table, tidy
from .tokens import TOGETHER, encoder, public, read_spec

PER_CHUNK = 1000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Fillings (times, lengths) that use up counts[length] pieces of each length."""
    left, out = counts.astype(np.int64).copy(), []
    sizes = np.arange(capacity + 1)
    while left.any():
        free, gap, bin_ = left.copy(), capacity, []
        fit = np.maximum.accumulate(np.where(free > 0, sizes, 0))  # the largest free length up to each
        while gap and (x := int(fit[gap])):
            n = min(int(free[x]), gap // x)
            bin_ += [x] * n
            gap -= n * x
            free[x] -= n
            if not free[x]:
                fit = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        if gap:
            least = bin_[-1]
            room = gap + least
            a = np.flatnonzero(free[: room + 1])
            twice = np.where((free[a] > 1) | (room - a < a), a, a - 1)
            b = fit[np.minimum(room - a, twice)] if len(a) else a
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > least:
                k = int(total.argmax())
                bin_[-1:] = [int(a[k]), int(b[k])]
        used = np.bincount(bin_, minlength=capacity + 1)
        need = np.flatnonzero(used)
        times = int((left[need] // used[need]).min())
        left[need] -= times * used[need]
        out.append((times, bin_))
    return out


def _tables(fillings: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: each stretch's first piece number, first sequence, pieces in a sequence, and their offsets."""
    rows: dict[int, list[tuple]] = {}
    sequence, seen = 0, {}
    for times, bin_ in fillings:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in bin_:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, o in offsets.items():
            rows.setdefault(x, []).append((seen.get(x, 0), sequence, len(o), o))
            seen[x] = seen.get(x, 0) + times * len(o)
        sequence += times
    out = {}
    for x, r in rows.items():
        offsets = np.concatenate([np.array(o, np.int64) for *_, o in r])
        each = np.array([n for _, _, n, _ in r], np.int64)
        out[x] = (np.array([a for a, *_ in r], np.int64), np.array([s for _, s, *_ in r], np.int64), each, np.cumsum(each) - each, offsets)
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and with keep_ids its ids, little-endian 32-bit."""
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches):
        import pyarrow as pa

        for batch in gathered(batches, text_col, TOGETHER):
            e = encoder(spec.value)
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            ids, counts = e.with_end(batch.column(1), end_id)
            raw, end = memoryview(ids.astype("<u4")).cast("B"), 0
            for d, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                begin, end = end, end + n
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    part = raw[4 * (begin + at) : 4 * (begin + at + size)]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(bytes(part))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        tidy()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PIECE + (", ids binary" if keep_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset."""
    rows = cut(pieces(docs, tokenizer, capacity, id_col, text_col, end_id, keep_ids), "packing-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    sent = rows.sparkSession.sparkContext.broadcast(_tables(plan(counts, capacity)))

    def place(rows) -> dict:
        size, k = rows.column("length").to_numpy(), rows.column("__number").to_numpy()
        sequence, offset = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i = order[a:b]
            first, bins, each, base, offsets = sent.value[int(size[i[0]])]
            at = np.searchsorted(first, k[i], side="right") - 1
            step = k[i] - first[at]
            sequence[i] = bins[at] + step // each[at]
            offset[i] = offsets[base[at] + step % each[at]]
        return {"sequence_id": sequence, "offset": offset}

    # so many chunks for each length that each has about `PER_CHUNK` pieces, whatever the number of documents
    chunks = F.element_at(F.array(*[F.lit(int(n) // PER_CHUNK + 1) for n in counts]), F.col("length").cast("int") + 1)
    out = numbered(rows, ["length"], ["doc_id", "piece"], "__number", "doc_id", chunks)
    return add_columns(out, place, {"sequence_id": "long", "offset": "long"}, ("__number",), "length")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))
