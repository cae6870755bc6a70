"""Token-id files with a minimal perfect hash index.

Documents are encoded where they lie; their ids are dealt by ranges of the key and sorted, and each range is written as one
shard: raw ids, little-endian, two bytes each where the vocabulary allows, and an index. Range bounds are quantiles of the
keys, and there is a shard for each `SHARD_BYTES` of input. The index is a minimal perfect hash of the shard's keys: at each
level a key that is alone in its bit sets it, the others go down a level, and the rank of a key's bit is its slot. A slot
holds a 32-bit fingerprint of the key, the offset and the number of ids, so a lookup reads one slot and one stretch of
ids, and a key that is not there is told by its fingerprint (wrongly once in 2**32). A small directory, one row a
shard, has first keys and id totals; it alone reaches the driver.

Files are written through Arrow's file systems into the shared folder under a temporary name and renamed when whole, so
a task that runs again leaves the same files. Null text is empty: one end id. A null key sorts first, as the least long. Rows with
the same key lie in one shard in the order of their ids: the first is occurrence 0, the next 1 and so on, and (key,
occurrence) is what is indexed. An empty table gives no shards and no rows. Extra columns are not stored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, opened, scratch, small_batches, table, tidy
from .tokens import TOGETHER, Encoder, encoder, public, read_spec

LEAST_KEY = -(1 << 63)
LEVELS = 64
SHARD_BYTES, MOST_SHARDS = 16 << 20, 10_000


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix, one-to-one for each seed."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joint_keys(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    plain = keys.astype(np.int64).view(np.uint64)
    return np.where(occurrence == 0, mixed(plain, 101), mixed(mixed(plain, 102) ^ occurrence.astype(np.uint64), 103))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys; other keys get some slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of bits, as bytes
        self.bits = [np.unpackbits(x) for x in levels]
        self.rank = [np.cumsum(b, dtype=np.int64) - b for b in self.bits]
        self.base = np.concatenate(([0], np.cumsum([int(b.sum()) for b in self.bits]))).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            bits = -(-(2 * len(keys) + 8) // 8) * 8
            at = (mixed(keys, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.bits):
            at = (mixed(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at] == 1
            out[left[here]] = self.base[k] + self.rank[k][at[here]]
            left = left[~here]
        return out


def _name(shard: int, kind: str) -> str:
    return f"shard-{shard:06d}.{kind}"


def _save_index(folder: str, shard: int, keys: np.ndarray, lengths: np.ndarray, width: int) -> None:
    hashed = PerfectHash.build(keys)
    slot = hashed.slots(keys)
    offset = np.cumsum(lengths) - lengths
    arrays = {"fingerprint": np.zeros(len(keys), "<u4"), "offset": np.zeros(len(keys), "<i8"), "length": np.zeros(len(keys), "<i8")}
    for name, values in (("fingerprint", mixed(keys, 201) & np.uint64(0xFFFFFFFF)), ("offset", offset), ("length", lengths)):
        arrays[name][slot] = values
    parts = [*((f"level{i}", x) for i, x in enumerate(hashed.levels)), *arrays.items()]
    head = json.dumps({"width": width, "parts": [[n, a.dtype.str, len(a)] for n, a in parts]}).encode()
    fs, path = opened(folder)
    temporary = f"{path}/_{_name(shard, 'idx')}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for _, a in parts:
            out.write(a.tobytes())
    fs.move(temporary, f"{path}/{_name(shard, 'idx')}")


class Shard:
    """One shard's index, and its ids by key."""

    def __init__(self, folder: str, shard: int):
        fs, path = opened(folder)
        with fs.open_input_stream(f"{path}/{_name(shard, 'idx')}") as f:
            raw = f.read()
        n = int.from_bytes(raw[:8], "little")
        head, at, arrays = json.loads(raw[8 : 8 + n]), 8 + n, {}
        for name, kind, size in head["parts"]:
            arrays[name] = np.frombuffer(raw, kind, size, at)
            at += arrays[name].nbytes
        self.hashed = PerfectHash([arrays[k] for k in arrays if k.startswith("level")])
        self.fingerprint, self.offset, self.length = arrays["fingerprint"], arrays["offset"], arrays["length"]
        self.width = head["width"]
        self.file = fs.open_input_file(f"{path}/{_name(shard, 'ids')}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and numbers of ids; -1 and 0 for a key that is not there."""
        slot = self.hashed.slots(keys)
        at = np.maximum(slot, 0)
        there = (slot >= 0) & (self.fingerprint[at] == (mixed(keys, 201) & np.uint64(0xFFFFFFFF))) if len(self.offset) else slot > 0
        return np.where(there, self.offset[at], -1), np.where(there, self.length[at], 0)

    def ids(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length * self.width, offset * self.width)


def crc_of(ids: bytes, width: int) -> int:
    """The CRC-32 of ids as 32-bit numbers."""
    return zlib.crc32(ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def _encoded(rows: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, int]:
    """(key, ids) of rows(key, text), and the bytes of an id."""
    spec = rows.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches):
        import pyarrow as pa

        for batch in gathered(batches, "text", TOGETHER):
            e = encoder(spec.value)
            ids, counts = e.with_end(batch.column(1), end_id)
            ends = np.concatenate(([0], np.cumsum(counts * e.width)))
            raw = ids.tobytes()
            for i in range(0, len(counts), 400):  # batches that stay small
                part = ends[i : i + 401]
                found = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer((part - part[0]).astype("<i4").tobytes()), pa.py_buffer(raw[part[0] : part[-1]])])
                yield pa.RecordBatch.from_arrays([batch.column(0).combine_chunks()[i : i + 400], found], ["key", "ids"])
        tidy()

    return rows.mapInArrow(run, "key long, ids binary"), Encoder(read_spec(tokenizer)).width


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Writes the shards; the directory: shard, first (key), docs and ids (numbers), start (ids in all shards before)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_KEY)).alias("key"), F.col(text_col).alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, or an estimate
    shards = shards or max(8, min(MOST_SHARDS, size // SHARD_BYTES))
    bounds = rows.agg(F.percentile_approx("key", [k / shards for k in range(1, shards)], 10 * shards)).first()[0] if shards > 1 else []
    edges = F.array(*[F.lit(int(x)) for x in sorted(set(bounds or []))]).cast("array<long>")
    encoded, width = _encoded(rows, tokenizer, end_id)

    def store(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, out, fs = TaskContext.get().partitionId(), None, None
        keys, lengths = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, path = opened(folder)
                temporary = f"{path}/_{_name(shard, 'ids')}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(temporary)
            found = batch.column(1)
            at = np.frombuffer(found.buffers()[1], "<i4", len(found) + 1, 4 * found.offset)
            keys.append(batch.column(0).to_numpy().copy())
            lengths.append(np.diff(at).astype(np.int64) // width)
            out.write(found.buffers()[2][int(at[0]) : int(at[-1])])
        if out is None:
            return
        out.close()
        fs.move(temporary, f"{path}/{_name(shard, 'ids')}")
        key, length = np.concatenate(keys), np.concatenate(lengths)
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        occurrence = np.arange(len(key)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(key)]))))
        _save_index(folder, shard, joint_keys(key, occurrence), length, width)
        found = [np.array([shard], np.int32), np.array([key[0]]), np.array([len(key)]), np.array([length.sum()])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["shard", "first", "docs", "ids"])

    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    at = F.size(F.filter(edges, lambda e: e <= F.col("key")))
    dealt = encoded.repartitionById(shards, at).sortWithinPartitions("key", "ids")
    found = sorted(dealt.mapInArrow(store, "shard int, first long, docs long, ids long").collect(), key=lambda r: r["shard"])
    start, directory = 0, []
    for r in found:
        directory.append(r.asDict() | {"start": start})
        start += r["ids"]
    return directory


def lookup(keys: DataFrame, folder: str, directory: list[dict], id_col: str = "doc_id") -> DataFrame:
    """keys (one row a stored document; rows with the same key count up the occurrences) with start, n_tokens and ids_crc32, read from the files."""
    firsts, shards, starts = (np.array([d[k] for d in directory], np.int64) for k in ("first", "shard", "start"))

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, key.to_numpy(np.int64), side="right") - 1, dtype="int32").clip(lower=0)

    def read(batches):
        at, shard = -1, None
        for rows in batches:
            for k, part in rows.groupby("at", sort=True):
                if k != at:
                    at, shard = k, Shard(folder, int(shards[k]))
                offset, length = shard.find(joint_keys(part["key"].to_numpy(np.int64), part["occurrence"].to_numpy(np.int64)))
                ids = [shard.ids(o, n) if n else b"" for o, n in zip(offset.tolist(), length.tolist(), strict=True)]
                yield pd.DataFrame({
                    "key": part["key"], "occurrence": part["occurrence"], "start": starts[k] + offset, "n_tokens": length,
                    "ids_crc32": [crc_of(x, shard.width) for x in ids],
                })

    schema = "key long, occurrence long, start long, n_tokens long, ids_crc32 long"
    if not directory:
        return keys.sparkSession.createDataFrame([], schema)
    count = F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1
    rows = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_KEY)).alias("key"))
    rows = rows.withColumns({"occurrence": count.cast("long"), "at": place("key")})
    return rows.repartitionById(len(directory), "at").sortWithinPartitions("at", "key", "occurrence").mapInPandas(read, schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "token-files")
    directory = write(docs, public("byte_bpe_50k.json"), folder)
    found = lookup(docs.select("doc_id"), folder, directory)
    return found.select(F.when(F.col("key") != LEAST_KEY, F.col("key")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
