"""Quality by ordinal cumulative-link regression.

A text's features are the words and symbol runs that occur in it, the words' beginnings, and the shares of words
that follow themselves, of different words and of symbols, lower-cased and hashed into one table. Graded ratings are learned with one weight a feature, shared by all grades, and ordered thresholds: P(grade <= k) = logistic(threshold_k - score).
The expected grade and the probability of at least `accept` follow for any text, and rows are selected by the latter.

Training takes up to `most_rated` rated rows, those of least hashed id: a bounded sample, the only bound; it is fitted
on the driver from hashed features. Features that fewer than `least_docs` of them have, or that are spread over the grades as chance
would have it (a z-score under `least_z`), have no weight; they are told by counts over the cluster and never reach the driver,
so long texts don't fill it. Prediction reads
whole texts. Null text counts as empty, and an empty text has the score 0. Rated ids that occur again count once, with
their least grade. Without two grades to learn from every row is selected, with probability 1. Repeated rows score
alike; an empty table gives an empty result. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, cut, discard, own_names, table, without

ADDED = ["expected_grade", "tail_prob", "selected"]
TABLE = 1 << 18
BEGINNINGS = (4, 5, 6)
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


def features(text: str | None) -> np.ndarray:
    """The sorted table places of the text's words, their beginnings, symbol runs, and how repetitive it is."""
    tokens = _TOKEN.findall((text or "").lower())
    seen = set(tokens)
    named = seen | {f"^{w[:k]}" for w in seen for k in BEGINNINGS if len(w) > k}
    if tokens:
        again = sum(map(eq, tokens, islice(tokens, 1, None)))
        named.add(f"#again {10 * again // len(tokens)}")
        named.add(f"#kinds {len(tokens).bit_length()} {10 * len(seen) // len(tokens)}")
        marks = [w for w in tokens if not w[0].isalpha()]
        named.add(f"#marks {10 * len(marks) // len(tokens)}")
        named.add(f"#long marks {20 * sum(len(w) > 2 for w in marks) // len(tokens)}")
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & TABLE - 1 for w in named), np.int32, len(named)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def telling(counts: dict[int, np.ndarray], least_docs: int, least_z: float) -> np.ndarray:
    """Which features are in enough texts, and in more or fewer of those above some grade than chance would have. counts: of
    each grade, in order, the number of texts with each feature, and after them the number of texts."""
    grades = sorted(counts)
    n = sum(int(counts[g][-1]) for g in grades)
    seen, most = sum(counts[g][:-1] for g in grades), np.zeros(TABLE)
    share = seen / max(n, 1)
    for k in range(1, len(grades)):
        up, n_up = sum(counts[g][:-1] for g in grades[k:]), sum(int(counts[g][-1]) for g in grades[k:])
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * n_up * (n - n_up) / n)
        most = np.maximum(most, np.abs(up - share * n_up) / spread)
    return (seen >= least_docs) & (most >= least_z)


def likelihood(score: np.ndarray, y: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood of grades y (0, 1 ...), and its slopes by each score and by each threshold."""
    edge = np.concatenate(([-np.inf], cuts, [np.inf]))
    upper, lower = logistic(edge[y + 1] - score), logistic(edge[y] - score)
    inside = np.maximum(upper - lower, 1e-9)
    up, low = upper * (1 - upper) / inside, lower * (1 - lower) / inside
    by_cut = (np.bincount(y, -up, len(cuts) + 1)[:-1] + np.bincount(y, low, len(cuts) + 1)[1:]) / len(y)
    return float(-np.log(inside).mean()), (up - low) / len(y), by_cut


class Model:
    """ids: each rated text's table places, of useful features alone."""

    def __init__(self, ids: list[np.ndarray], grades: list[int], rounds: int = 200, decay: float = 1e-3):
        self.grades = sorted(set(grades))
        self.weights = np.zeros(TABLE, np.float32)
        self.thresholds = np.zeros(0)
        if len(self.grades) < 2:
            return
        y = np.array([self.grades.index(g) for g in grades])
        useful, flat = np.unique(np.concatenate(ids), return_inverse=True)
        of = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        share = np.bincount(y, minlength=len(self.grades)) / len(y)
        below = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
        cuts = np.log(below / (1 - below))
        w, n = np.zeros(len(useful)), len(y)
        state = [np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(cuts)), np.zeros(len(cuts))]
        for t in range(1, rounds + 1):
            pace = 0.1 if 3 * t < 2 * rounds else 0.02
            _, slope, by_cut = likelihood(np.bincount(of, w[flat], n), y, cuts)
            by_w = np.bincount(flat, slope[of], len(w)) + decay * w
            for x, g, k in ((w, by_w, 0), (cuts, by_cut, 2)):
                state[k] += 0.1 * (g - state[k])
                state[k + 1] += 0.01 * (g * g - state[k + 1])
                x -= pace * (state[k] / (1 - 0.9**t)) / (np.sqrt(state[k + 1] / (1 - 0.99**t)) + 1e-7)
            cuts.sort()
        self.weights[useful] = w
        self.thresholds = cuts

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for all but the last grade, a row for each text."""
        score = np.array([self.weights[features(t)].sum(dtype=np.float64) for t in texts])
        return logistic(score[:, None] - self.thresholds[None, :])


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rated: int = 12_000, least_docs: int = 8, least_z: float = 5.0, **options) -> Model:
    """ratings: id_col and an integer grade."""
    rated = ratings.select(F.col(id_col), F.col("grade").cast("int")).dropna().groupBy(id_col).agg(F.min("grade").alias("grade"))
    total = rated.count()
    if not total:
        return Model([], [])
    part = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) <= min(1 << 30, (1 << 30) * 5 // 4 * most_rated // total)
    sample = rated.filter(part).orderBy(F.xxhash64(id_col), id_col).limit(most_rated)
    texts = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    found = add_columns(texts, lambda rows: {"ids": [features(t) for t in rows.column(text_col).to_pylist()]}, {"ids": "array<int>"}, (text_col,), text_col)
    found = cut(found.select("ids", "grade"), "quality-features")
    size = found.groupBy("grade").count().collect()  # a row a grade
    counts = {r["grade"]: np.zeros(TABLE + 1, np.int64) for r in size}
    for r in size:
        counts[r["grade"]][-1] = r["count"]
    have = found.select("grade", F.explode("ids").alias("id")).groupBy("grade", "id").count().filter(F.col("id").isNotNull())
    have = have.toArrow()  # at most a table for each grade
    for g in counts:
        here = have.column("grade").to_numpy() == g
        counts[g][have.column("id").to_numpy()[here]] = have.column("count").to_numpy()[here]
    sent = docs.sparkSession.sparkContext.broadcast(telling(counts, least_docs, least_z))
    keep = lambda rows: {"kept": [x[sent.value[x]] for x in (np.array(i, np.int32) for i in rows.column("ids").to_pylist())]}
    arrow = add_columns(found, keep, {"kept": "array<int>"}, ("ids",), "ids").toArrow()
    discard(found)
    flat = arrow.column("kept").combine_chunks()
    lengths = flat.value_lengths().to_numpy(zero_copy_only=False)
    ids = np.split(flat.flatten().to_numpy(), np.cumsum(lengths)[:-1]) if len(lengths) else []
    return Model(ids, arrow.column("grade").to_pylist(), **options)


@own_names
def grade(docs: DataFrame, model: Model, accept: int, text_col: str = "text", least: float = 0.5, keep_text: bool = True) -> DataFrame:
    """All rows and columns of docs with expected_grade, tail_prob (of a grade of `accept` or more) and selected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(rows) -> dict:
        m, texts = sent.value, rows.column(text_col).to_pylist()
        if not len(m.thresholds):
            return {"expected_grade": [float(m.grades[0]) if m.grades else 0.0] * len(texts), "tail_prob": [1.0] * len(texts)}
        above, steps = m.above(texts), np.diff(m.grades)
        lower = sum(g < accept for g in m.grades)  # grades that are not accepted
        tail = np.ones(len(texts)) if lower == 0 else np.zeros(len(texts)) if lower == len(m.grades) else above[:, lower - 1]
        return {"expected_grade": m.grades[0] + above @ steps, "tail_prob": tail}

    out = add_columns(without(docs, ADDED), compute, {"expected_grade": "double", "tail_prob": "double"}, () if keep_text else (text_col,), text_col)
    return out.withColumn("selected", F.col("tail_prob") >= least)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the labels: 0 toxic, 1 of low quality, 2 neither."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    return fit(table(spark, sf_dir, "documents"), ratings(table(spark, sf_dir, "labels")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, fitted(spark, sf_dir), accept=2, keep_text=False).select("doc_id", *ADDED)
