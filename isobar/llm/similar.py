"""Near copies by SimHash blocks: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text's fingerprint is the SimHash of its set of words, as many bits as `BLOCKS` blocks need; a block is a few bits wider
than the number of texts has binary digits, so that unlike texts seldom meet whatever their number. Texts that share
four fifths of their shingles differ in about a twentieth of the bits and so share some of the blocks. They are joined
on the blocks and linked if a further 128 fingerprint bits are within the Hamming distance; over `MOST` texts on a block
that are unlike its first ones are linked without. What is linked so far is a candidate group, and a superset of the answer.

Each candidate group is then verified exactly, on sets of 64-bit hashes of shingles: `CHUNK` texts at a time meet in one
task, where all their similarities are one matrix product. Of a group of several chunks, each chunk is verified alone,
then the best linked texts of all chunks, and last every text outside the largest component against all the group's
chunks, so no link between different components is left out and a group of close copies takes linear time.

The result is single linkage over verified pairs: component_id is the smallest id that is reached. Null, empty and blank
texts have no shingles and are alike. Texts of fewer than five words have one shingle. Repeated rows are one text. A
null id counts only where there is no other. An empty table gives an empty result. Input columns named like an added
one are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, attach, bloom_probe, bloom_words, components, cut, discard, own_names, release, small_batches, tidy, without

SHINGLE = 5
BLOCKS = 32
MOST = 16
#: Bits of 128 in which candidates may differ; copies at 0.8 differ in some 8, and seldom in over 24.
NEAR = 36
CHUNK, CHUNK_WORDS = 128, 100_000
_ODD = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 63, 40, np.uint64) << np.uint64(1) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted different hashes of five words in a row; all words where there are fewer."""
    if not len(words):
        return words
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _ODD[-1] + words[k : len(words) - n + 1 + k]
    return np.unique(_mixed(out))


def word_bits(words: np.ndarray, seeds: int) -> np.ndarray:
    """The SimHash bits of the set of words, 64 for each seed; no words, no bits."""
    kinds = np.unique(words)
    ones = np.zeros(64 * seeds, np.int64)
    for i in range(0, len(kinds), 255):
        drawn = _mixed(_mixed(kinds[i : i + 255, None] * _ODD[:seeds]) * _ODD[:seeds])
        ones += np.unpackbits(drawn.view(np.uint8).reshape(len(drawn), -1), axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(kinds)


def _sketches(texts: list, width: int) -> dict:
    seeds = -(-BLOCKS * width // 64) + 2
    out: dict[str, list] = {"__words": [], "__blocks": [], "__f1": [], "__f2": []}
    powers = np.int64(1) << np.arange(width, dtype=np.int64)
    for t in texts:
        words = word_hashes(t)
        bits = word_bits(words, seeds)
        f1, f2 = np.packbits(bits[:128]).view(">i8").tolist()
        keys = bits[128 : 128 + BLOCKS * width].reshape(BLOCKS, width) @ powers
        for n, v in zip(out, (len(words), keys.tolist(), f1, f2), strict=True):
            out[n].append(v)
    return out


def _text_keys(text_col: str) -> list[Column]:
    """A 128-bit key of a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.lit(x), text).alias(n) for x, n in ((11, "__k1"), (12, "__k2"))]


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}f1").bitwiseXOR(F.col(f"{b}f1"))) + F.bit_count(F.col(f"{a}f2").bitwiseXOR(F.col(f"{b}f2")))


def candidates(each: DataFrame, n_texts: int) -> DataFrame:
    """(node, label): groups of texts that blocks and Hamming distance link, of each(node, blocks, f1, f2).

    Of the texts on a block those near its first text are linked with that, then those of the rest near the rest's first
    text, and what is still left in pairs, so that copies make one edge a block each and not all their pairs.
    """
    block = F.posexplode("blocks").alias("b", "x")
    rest = each.select("node", "f1", "f2", block).select("node", "f1", "f2", (F.shiftleft(F.col("b").cast("long"), 40) + F.col("x")).alias("key"))
    edges, tables = None, []
    for k in range(2):
        first = rest.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("node", "f1", "f2")).alias("hub")).filter("m > 1")
        met = attach(rest, first, "key", "m", n_texts).filter("m IS NOT NULL AND node <> hub.node")
        met = cut(met.select("key", "node", "f1", "f2", F.col("hub.node").alias("hub"), (_differ("", "hub.") <= NEAR).alias("near")), f"similar-met-{k}")
        near = met.filter("near").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
        edges = near if edges is None else edges.unionByName(near)
        rest = met.filter("NOT near").select("key", "node", "f1", "f2")
        tables.append(met)
        release(each.sparkSession)
    left = rest.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("hub")).filter("m > 1")
    left = cut(attach(rest, left, "key", "m", n_texts).filter("m IS NOT NULL"), "similar-met-rest")
    few = left.filter(F.col("m") <= MOST)
    pairs = few.alias("a").join(few.alias("b"), "key").filter((F.col("a.node") < F.col("b.node")) & (_differ("a.", "b.") <= NEAR))
    stars = left.filter((F.col("m") > MOST) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("u"), F.col("node").alias("v"))
    edges = edges.unionByName(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))).unionByName(stars)
    out = components(edges, "similar-groups")
    discard(*tables, left)
    release(each.sparkSession)
    return out


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs have 0.8 or more in common: products of slices of the sets' incidence matrix."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = count[column] > 1
    owner, column = owner[again], (np.cumsum(count > 1) - 1)[column[again]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        part = np.zeros((len(sets), int(column[b - 1]) - first + 1), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        shared += part @ part.T
    return 9 * shared >= 4 * (size[:, None] + size[None, :])


def roots(near: np.ndarray) -> np.ndarray:
    """The first member of each one's component."""
    out = np.full(len(near), -1)
    for i in range(len(near)):
        if out[i] < 0:
            todo = np.zeros(len(near), bool)
            todo[i] = True
            while todo.any():
                out[todo] = i
                todo = near[todo].any(axis=0) & (out < 0)
    return out


def verified(members: DataFrame) -> DataFrame:
    """(node, root, degree) of members(g, node, set): each group g is small enough for one task, and all its pairs are verified."""
    small_batches(members.sparkSession)

    def run(batches):
        import pyarrow as pa

        group, nodes, sets = None, [], []

        def done():
            near = alike(sets)
            node = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[roots(near)]), pa.array(near.sum(axis=1))], ["node", "root", "degree"])

        for batch in batches:
            found = batch.column(2)
            flat, at = found.values.to_numpy().view(np.uint64), found.offsets.to_numpy()
            for k, (g, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if g != group and nodes:
                    yield done()
                    nodes, sets = [], []
                group = g
                nodes.append(n)
                sets.append(flat[at[k] : at[k + 1]].copy())
        if nodes:
            yield done()
        tidy()

    rows = members.select("g", "node", "set").repartition("g").sortWithinPartitions("g", "node")
    return rows.mapInArrow(run, "node long, root long, degree long")


def _sets(texts: DataFrame, text_col: str, name: str) -> DataFrame:
    compute = lambda rows: {"set": [shingle_set(word_hashes(t)).view(np.int64) for t in rows.column(text_col).to_pylist()]}
    return cut(add_columns(texts, compute, {"set": "array<long>"}, (text_col,), text_col), name)


def links(rows: DataFrame, each: DataFrame, group: DataFrame, text_col: str, n_texts: int) -> DataFrame:
    """(node, label): the components of all verified pairs within the candidate groups."""
    members = cut(group.withColumnRenamed("label", "group").join(each.select("node", "__k1", "__k2", "words"), "node"), "similar-members")
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("words") / CHUNK_WORDS))
    sizes = members.groupBy("group").agg(F.count("*").alias("m"), parts.cast("int").alias("chunks"))
    held = attach(members, sizes, "group", "m", n_texts).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    held = cut(held.drop("m", "words"), "similar-chunks")
    probed = bloom_probe(rows, bloom_words(held, "__k1"), "__k1").dropDuplicates(["__k1", "__k2"])
    sets = _sets(probed.select("__k1", "__k2", text_col).join(held, ["__k1", "__k2"]).drop("__k1", "__k2"), text_col, "similar-sets")
    discard(members, held)
    release(rows.sparkSession)
    alone = cut(verified(sets.withColumn("g", F.xxhash64("group", "chunk"))), "similar-verified")
    edges = alone.select(F.col("node").alias("u"), F.col("root").alias("v"))
    large, tables = sets.filter("chunks > 1"), [sets, alone]
    if large.head(1):
        best = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("degree"), "node"))
        chosen = alone.filter("degree > 1").withColumn("place", best).filter("place <= 8").select("node")
        chosen = cut(large.join(chosen, "node"), "similar-chosen")
        between = F.xxhash64("group", F.pmod(F.xxhash64("node"), F.ceil(F.col("chunks") * 8 / CHUNK)))
        edges = edges.unionByName(verified(chosen.withColumn("g", between)).select(F.col("node").alias("u"), F.col("root").alias("v")))
        edges = cut(edges, "similar-edges")
        more, used = _rest(large, components(edges, "similar-cc"), n_texts)
        tables += [chosen, edges, *used]
        edges = edges.unionByName(more)
    out = components(edges, "similar-cc")
    discard(*tables)
    release(rows.sparkSession)
    return out


def _rest(large: DataFrame, label: DataFrame, n_texts: int) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v), and the tables that it is made from: verified pairs of the texts outside their group's largest component with all the group's texts."""
    ids = large.select("node", "group", "chunk", "chunks").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = cut(ids, "similar-labels")
    discard(label)
    part = ids.groupBy("group", "label").agg(F.count("*").alias("c"))
    main = part.groupBy("group").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("m"), (F.sum("c") - F.max("c")).alias("left")).filter("left > 0")
    open_ = attach(ids, main, "group", "m", n_texts).filter("main IS NOT NULL")
    open_ = cut(open_.withColumn("rounds", F.ceil(F.col("left") / CHUNK).cast("int")), "similar-open")
    outside = open_.filter("label <> main").withColumn("i", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("rounds")).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = outside.select("node", "group", "i", upto("chunks").alias("j")).unionByName(open_.select("node", "group", upto("rounds").alias("i"), F.col("chunk").alias("j")))
    pairs = dealt.select("node", F.xxhash64(F.lit(5), "group", "i", "j").alias("g")).distinct().join(large.select("node", "set"), "node")
    return verified(pairs).select(F.col("node").alias("u"), F.col("root").alias("v")), [ids, open_]


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows alone in their group, and the others with component_id and __node, the component."""
    base = without(docs, ["component_id"])
    rows = base.select("*", *_text_keys(text_col))
    n_rows = docs.count()
    width = min(32, max(12, n_rows.bit_length() + 3))
    added = {"__words": "int", "__blocks": "array<long>", "__f1": "long", "__f2": "long"}
    slim = rows.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), "__k1", "__k2")
    sketched = cut(add_columns(slim, lambda r: _sketches(r.column("__text").to_pylist(), width), added, ("__text",), "__text"), "similar-sketches")
    first = [F.first(f"__{n}").alias(n) for n in ("words", "blocks", "f1", "f2")]
    each = sketched.groupBy("__k1", "__k2").agg(F.min("__id").alias("low"), F.count("*").alias("n"), *first)
    each = cut(each.withColumn("node", F.monotonically_increasing_id()), "similar-texts")
    discard(sketched)
    groups = candidates(each, n_rows)
    found = links(slim.withColumnRenamed("__text", text_col), each, groups, text_col, n_rows)
    named = each.select("__k1", "__k2", "node", "low", "n").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut(named, "similar-named")
    discard(each, groups, found)
    group = named.groupBy("label").agg(F.min("low").alias("component_id"), F.sum("n").alias("all"), F.count("*").alias("texts")).filter("all > 1")
    of_text = attach(named, group, "label", "texts", n_rows).filter("all IS NOT NULL")
    of_text = cut(of_text.select("__k1", "__k2", F.col("label").alias("__node"), "component_id", F.col("n").alias("__n")), "similar-components")
    discard(named)
    maybe = bloom_probe(rows, bloom_words(of_text, "__k1"), "__k1", keep=True)
    met = attach(maybe.filter("__maybe"), of_text, ["__k1", "__k2"], "__n", n_rows)
    gone = ("__k1", "__k2", "__maybe")
    return maybe.filter("NOT __maybe").drop(*gone), met.drop(*gone, "__n")


@own_names
def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with component_id."""
    free, met = _grouped(docs, id_col, text_col)
    own = F.when(F.col("__node").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return free.withColumn("component_id", F.col(id_col)).unionByName(met.withColumn("component_id", own).drop("__node"))


@own_names
def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of its smallest id, in docs' columns."""
    free, met = _grouped(docs, id_col, text_col)
    single, several = met.filter("__node IS NULL"), met.filter(F.col("__node").isNotNull() & F.col(id_col).eqNullSafe(F.col("component_id")))
    one = several.withColumn("__row", F.row_number().over(Window.partitionBy("__node").orderBy(F.lit(0)))).filter("__row = 1")
    names = [c for c in docs.columns if c in free.columns]
    return free.select(names).unionByName(single.select(names)).unionByName(one.select(names))
