"""Sharding by minimax contiguous partition, DataFrame operations only.

Rows with equal texts form one atomic group. Groups stand in the order of the SHA-256 of their text; `shards`
contiguous runs of groups are cut so that the largest run's bytes are as few as any such cut allows. The smallest
feasible capacity is found by binary search, where each test places its cuts greedily, the furthest group end within the
capacity. Groups lie in buckets of about `PER_BUCKET` by the first digits of the hash. The buckets' totals, 16**5 numbers at
most, reach the driver and bound the search; then only the buckets in which a cut can fall are read, each as a list of
group sizes. A row's shard follows from comparing its own hash with the cuts, so no row is joined or moved to find it.

Null text is as empty text: size 1 and one group with it. An empty table gives an empty result. A group larger than
all else together makes the capacity its own size. Input columns named like an added one are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, numbered, own_names, table, without

ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
PER_BUCKET = 10_000


class Order:
    """The groups' sizes in the order of their hashes, of groups(g hex, bytes, b); a bucket's own are read when a cut may fall in it."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        found = sorted((r["b"], r["in_b"], r["most"]) for r in groups.groupBy("b").agg(F.sum("bytes").alias("in_b"), F.max("bytes").alias("most")).collect())
        self.buckets, self.ends = [b for b, *_ in found], list(accumulate(n for _, n, _ in found))
        self.total, self.largest = (self.ends[-1] if found else 0), max((m for *_, m in found), default=0)
        self.read: dict[int, tuple[list[int], list[str]]] = {}

    def _bucket(self, k: int) -> tuple[list[int], list[str]]:
        """The prefix sums at its groups' ends, and the groups."""
        if k not in self.read:
            rows = sorted((r["g"], r["bytes"]) for r in self.groups.filter(F.col("b") == self.buckets[k]).select("g", "bytes").collect())
            before = self.ends[k - 1] if k else 0
            self.read[k] = [before + x for x in accumulate(n for _, n in rows)], [g for g, _ in rows]
        return self.read[k]

    def furthest(self, limit: int) -> tuple[int, str]:
        """The last group end that is not beyond limit: its prefix sum and group; 0 and "" before the first."""
        k = bisect_right(self.ends, limit)
        if k < len(self.ends):
            ends, names = self._bucket(k)
            at = bisect_right(ends, limit)
            if at:
                return ends[at - 1], names[at - 1]
        return (self.ends[k - 1], self._bucket(k - 1)[1][-1]) if k else (0, "")

    def greedy(self, capacity: int, shards: int, whole_buckets: bool = False) -> list[tuple[int, str]]:
        """The ends of the first shards - 1 runs; with whole_buckets cuts fall between buckets only, and nothing is read."""
        out, at = [], 0
        for _ in range(shards - 1):
            if whole_buckets:
                k = bisect_right(self.ends, at + capacity)
                found = (self.ends[k - 1] if k else 0, "")
            else:
                found = self.furthest(at + capacity)
            at = found[0]
            out.append(found)
        return out

    def smallest(self, shards: int, low: int, high: int, whole_buckets: bool = False) -> int:
        """The least capacity from low to high under which the last run fits too; high is known to do."""
        while low < high:
            mid = (low + high) // 2
            ends = self.greedy(mid, shards, whole_buckets)
            if self.total - (ends[-1][0] if ends else 0) <= mid:
                high = mid
            else:
                low = mid + 1
        return high


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity, and the last group of each run but the last under it; "": the run is empty."""
    order = Order(groups)
    low = max(order.largest, -(-order.total // shards))
    high = order.smallest(shards, low, order.total, whole_buckets=True)
    best = order.smallest(shards, low, high)
    return best, [g for _, g in order.greedy(best, shards)]


@own_names
def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with size, text_crc32, law, shard, slot and grown_shard (null: the law is bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = without(docs, ADDED).withColumns(
        {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "__g": F.sha2(text.cast("binary"), 256)}
    )
    slim = cut(rows.select("__g", "size"), "shard-sizes")
    n_rows = slim.count()
    digits = next(d for d in range(1, 6) if d == 5 or n_rows <= PER_BUCKET * 16**d)
    groups = slim.groupBy(F.col("__g").alias("g")).agg(F.sum("size").alias("bytes")).withColumn("b", F.substring("g", 1, digits))
    groups = cut(groups.repartitionByRange("b").sortWithinPartitions("b"), "shard-groups")  # files by bucket, so that few are read for one
    discard(slim)
    _, cuts = minimax_cuts(groups, shards)
    discard(groups)
    number = reduce(lambda a, b: a + b, [(F.col("__g") > c).cast("int") for c in cuts], F.lit(0))
    placed = rows.withColumns({"law": F.lit("bytes"), "shard": number, "grown_shard": F.lit(None).cast("int")})
    return numbered(placed, ["shard"], [id_col, "__g"], "slot", id_col, F.lit(n_rows // 20_000 + 1)).drop("__g")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *ADDED)
