"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Lines have ids, the ranks of their hashes among all lines that occur again. A position's rank for runs of 2k lines is
the place of the pair (its rank for k lines, the rank k lines on) in the sorted order of such pairs, so after each
doubling the ranks order the suffixes by twice as many lines. A position whose run is found nowhere else leaves: its
place in the order is settled and no longer repeat starts there. Doubling ends when all ranks have settled. Positions
of equal rank at a depth are an interval of the suffix array whose common prefix is at least that depth; the first one
by id and line is the interval's source, the others are later copies. A later copy's deepest interval gives its source,
and the two suffixes' common prefix, found by going back through the depths, gives the maximal repeated run. Runs of
`least_lines` lines or `least_bytes` bytes, whichever they reach, are deleted where they are later copies.

Lines are parted by line feeds. Null text is one empty line, as empty text is. Rows repeated in all of id and text are
one row to the judgement: each loses the lines that copy other rows, and no repeat of the row itself is deleted. A null id
comes first; rows of one id are in the order of a hash. Overlapping repeats within a row count. An empty table gives an
empty result. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, attach, bloom_probe, bloom_words, cut, discard, own_names, release, table, without

ADDED = ["n_lines", "n_removed", "n_runs", "kept_sha256"]
PLACE = ["id", "key", "at"]


def _ranked(positions: DataFrame, by: list[str], name: str, n_rows: int) -> DataFrame:
    """Uses up the table of positions. (id, key, at, rank, source, size): positions whose `by` occurs again, ranked in its order; source: the first position that has it, null for that itself."""
    here = F.struct(*PLACE)
    groups = positions.groupBy(*by).agg(F.count("*").alias("n"), F.min(here).alias("source"), *([F.first("size").alias("size")] if "size" in positions.columns else [])).filter("n > 1")
    # ids that increase along sorted ranges are ranks with gaps
    ordered = groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
    ordered = cut(ordered, f"{name}-groups")
    joined = attach(positions.drop("size"), ordered, by, "n", n_rows).filter("rank IS NOT NULL")
    source = F.when(~here.eqNullSafe(F.col("source")), F.col("source"))
    out = cut(joined.select(*PLACE, "rank", source.alias("source"), *(["size"] if "size" in ordered.columns else [])), f"{name}-ranks")
    discard(positions, ordered)
    return out


def _same(a: str, b: str):
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in PLACE]


def suffix_ranks(rows: DataFrame) -> list[DataFrame]:
    """The ranks at depths of 1, 2, 4 ... lines, until no run repeats, of rows(id, key, text); the first has the lines' bytes."""
    lines = rows.select("id", "key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hashed = lines.select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.octet_length("line").alias("size")).dropDuplicates(PLACE)
    hashed = cut(hashed, "lines")
    n_rows = hashed.count()
    levels = [_ranked(hashed, ["h1", "h2"], "lines-1", n_rows)]
    while levels[-1].head(1):
        depth = 1 << len(levels) - 1
        ranks = levels[-1].select(*PLACE, "rank")
        ahead = ranks.select("id", "key", (F.col("at") - depth).alias("at"), F.col("rank").alias("r2"))
        pairs = ranks.alias("a").join(ahead.alias("b"), _same("a", "b")).select("a.id", "a.key", "a.at", F.col("a.rank").alias("r1"), "b.r2")
        if depth == 2:
            release(rows.sparkSession)
        levels.append(_ranked(cut(pairs, f"lines-pairs-{2 * depth}"), ["r1", "r2"], f"lines-{2 * depth}", n_rows))
    return levels[:-1]


def maximal_runs(levels: list[DataFrame]) -> DataFrame:
    """(id, key, at, lines, source, size): the runs that copy earlier lines and can't be prolonged; size: the first line's bytes."""
    if not levels:
        raise ValueError("no levels")
    depth = [x.select(*PLACE, "source", F.lit(k).alias("level")) for k, x in enumerate(levels)]
    every = depth[0]
    for x in depth[1:]:
        every = every.unionByName(x)
    later = every.filter("source IS NOT NULL").groupBy(*PLACE).agg(F.max_by("source", "level").alias("source"), F.max("level").alias("level"))
    before = Window.partitionBy("id", "key").orderBy("at")
    follows = lambda x: F.lag(x).over(before)
    goes_on = (
        (follows("at") + 1 == F.col("at")) & (follows("level") == F.col("level")) & follows("source.id").eqNullSafe(F.col("source.id"))
        & (follows("source.key") == F.col("source.key")) & (follows("source.at") + 1 == F.col("source.at"))
    )
    heads = later.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).filter("NOT goes_on").drop("goes_on")
    runs = cut(heads.withColumn("lines", F.lit(0)), "lines-heads")
    for k in range(len(levels) - 1, -1, -1):
        runs = _prolonged(runs, levels[k].select(*PLACE, "rank"), 1 << k)
        if k % 4 == 0:
            runs = cut(runs, f"lines-runs-{k}")
    return runs.drop("level")


def _prolonged(runs: DataFrame, ranks: DataFrame, depth: int) -> DataFrame:
    """runs, longer by depth where run and source have equal ranks at the lines after their ends by now."""
    mine = runs.withColumns({"a_at": F.col("at") + F.col("lines"), "b_at": F.col("source.at") + F.col("lines")})
    for side, where in (("a", ""), ("b", "source.")):
        there = ranks.select(F.col("id").alias("r_id"), F.col("key").alias("r_key"), F.col("at").alias("r_at"), F.col("rank").alias(f"{side}_rank"))
        same = F.col(f"{where}id").eqNullSafe(F.col("r_id")) & (F.col(f"{where}key") == F.col("r_key")) & (F.col(f"{side}_at") == F.col("r_at"))
        mine = mine.join(there, same, "left").drop("r_id", "r_key", "r_at")
    more = F.when(F.col("a_rank") == F.col("b_rank"), F.lit(depth)).otherwise(0)
    return mine.withColumn("lines", F.col("lines") + more).select(*runs.columns)


def later_copies(rows: DataFrame, least_lines: int, least_bytes: int) -> DataFrame:
    """(id, key, runs): the first lines and lengths of the runs to delete, of rows(id, key, text)."""
    levels = suffix_ranks(rows)
    if not levels:
        return rows.limit(0).select("id", "key", F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("lines"))).alias("runs"))
    runs = maximal_runs(levels)
    if least_lines > 1:
        alone = levels[0].filter(F.col("source").isNotNull() & (F.col("size") >= least_bytes)).select(*PLACE, F.lit(1).alias("lines"))
        runs = runs.filter(F.col("lines") >= least_lines).select(*PLACE, "lines").unionByName(alone)
    return runs.groupBy("id", "key").agg(F.collect_list(F.struct("at", "lines")).alias("runs"))


def _dropped(rows, text_col: str) -> dict:
    out: dict[str, list] = {n: [] for n in [*ADDED, "kept_text"]}
    for text, runs in zip(rows.column(text_col).to_pylist(), rows.column("__runs").to_pylist(), strict=True):
        lines, kept, at, n_runs = (text or "").split("\n"), [], 0, 0
        for a, n in sorted((r["at"], r["lines"]) for r in runs or ()):
            if a > at or not n_runs and a == at:
                n_runs += 1
            kept += lines[at:a]
            at = max(at, a + n)
        kept_text = "\n".join(kept + lines[at:])
        removed = len(lines) - len(kept) - len(lines[at:])
        for n, v in zip(out, (len(lines), removed, n_runs, hashlib.sha256(kept_text.encode("utf-8", "surrogatepass")).hexdigest(), kept_text), strict=True):
            out[n].append(v)
    return out


@own_names
def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 2, least_bytes: int = 32, keep_text: bool = True) -> DataFrame:
    """All rows and columns of docs with n_lines, n_removed, n_runs, kept_sha256 and, with keep_text, kept_text."""
    base = without(docs, [*ADDED, "kept_text"])
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    runs = later_copies(base.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), least_lines, least_bytes)
    later = cut(runs, "lines-later")
    maybe = bloom_probe(base.withColumn("__key", key), bloom_words(later, "key"), "__key", keep=True)
    hit = later.select(F.col("id").alias("__id"), F.col("key").alias("__key2"), F.col("runs").alias("__runs"))
    touched = maybe.filter("__maybe").join(hit, (F.col("__key") == F.col("__key2")) & F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id", "__key2")
    free = maybe.filter("NOT __maybe").withColumn("__runs", F.lit(None).cast(later.schema["runs"].dataType))
    both = touched.unionByName(free).drop("__key", "__maybe")
    added = {"n_lines": "long", "n_removed": "long", "n_runs": "long", "kept_sha256": "string"} | ({"kept_text": "string"} if keep_text else {})
    gone = ("__runs", *(() if keep_text else (text_col,)))
    return add_columns(both, lambda r: _dropped(r, text_col), added, gone, text_col)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", *ADDED)


OP3_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS p
  FROM documents),
w AS (SELECT doc_id, p, line, lead(line) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM l),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, p) AS copy FROM w WHERE next IS NOT NULL),
o AS (SELECT doc_id, p, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS copy FROM l WHERE strlen(line) >= 32),
d AS (SELECT doc_id, p FROM r WHERE copy > 1 UNION SELECT doc_id, p + 1 FROM r WHERE copy > 1 UNION SELECT doc_id, p FROM o WHERE copy > 1),
m AS (SELECT l.doc_id, l.p, l.line, d.p IS NOT NULL AS gone FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.p = d.p),
n AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS before FROM m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM n GROUP BY doc_id
"""
