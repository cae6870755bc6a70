"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of character n-grams of lengths 1 to 4: for each length the number of
n-grams present in both over the geometric mean of the numbers in each, and the mean of the four. `landmarks` training
windows, one of a text, span a Nyström feature space; one ridge regression for each language tells it from the rest. A text is scored
in windows of `width` letters and spaces, all of it, by products of presence matrices with the landmarks' and then
with the weights; a text's score is the mean over its windows by their length, and the largest of all languages wins.

Training takes up to `per_language` labelled rows a language, those of least hashed id: a bounded sample, and the only
bound. All windows of each sampled text are learned from, a text at a time, each text weighing as much as another. n-grams are hashed into
fixed tables. Null text and text without a letter are "und" with score 0; so is all text if no label is there to
learn from. Ties go to the first language by name. Repeated rows score alike; an empty table gives an empty result.
Input columns named like an added one are replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, cut, discard, own_names, table, without

ADDED = ["lang_pred", "score"]
#: Presence tables of 1-grams to 4-grams.
TABLES = (256, 2048, 4096, 8192)
OFFSETS = tuple(int(x) for x in np.cumsum((0, *TABLES)))
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def cleaned(text: str | None) -> str:
    return f" {_OTHER.sub(' ', (text or '').lower()).strip()} "


def windows_of(text: str, width: int) -> list[str]:
    """All of the text, in pieces of width; a short rest joins the piece before it."""
    cuts = [*range(0, max(1, len(text) - width // 2), width)]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def presence(windows: list[str]) -> np.ndarray:
    """A row of n-gram bits for each window."""
    sizes = np.array([len(w) for w in windows])
    row = np.repeat(np.arange(len(windows)), sizes)
    code = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(windows), OFFSETS[-1]), np.float32)
    flat, h = out.ravel(), np.zeros(len(code), np.uint32)
    for n, buckets in enumerate(TABLES, 1):
        if len(code) < n:
            break
        h = code.copy() if n == 1 else h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
        bucket = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1)
        whole = row[: len(h)] == row[n - 1 :]
        flat[(row[: len(h)] * OFFSETS[-1] + OFFSETS[n - 1] + bucket)[whole]] = 1
    return out


def kernel(x: np.ndarray, landmarks: list[np.ndarray]) -> np.ndarray:
    """Of each row of presence bits with each landmark; landmarks: per n-gram length, scaled."""
    total = 0
    for n, marks in enumerate(landmarks):
        part = x[:, OFFSETS[n] : OFFSETS[n + 1]]
        total = total + part @ marks / np.sqrt(np.maximum(part.sum(axis=1), 1))[:, None]
    return total / len(landmarks)


def scaled(x: np.ndarray) -> list[np.ndarray]:
    parts = [x[:, a:b] for a, b in zip(OFFSETS, OFFSETS[1:], strict=False)]
    return [np.ascontiguousarray((p / np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None]).T) for p in parts]


class Model:
    """rows(): (text, language) of the training rows, each time it is called; one text is held at a time."""

    def __init__(self, rows, landmarks: int, ridge: float, width: int, batch: int = 64):
        self.width = width
        count: dict[str, int] = {}
        for text, lang in rows():
            if _LETTER.search(text):
                count[lang] = count.get(lang, 0) + 1
        self.langs = sorted(count)
        if not self.langs:
            return
        each, taken, marks = max(1, landmarks // len(self.langs)), dict.fromkeys(self.langs, 0), []
        for text, lang in rows():
            if _LETTER.search(text) and taken[lang] < each:
                windows = windows_of(cleaned(text), width)
                marks.append(windows[len(windows) // 2])
                taken[lang] += 1
        chosen = presence(marks)
        self.marks = scaled(chosen)
        value, vector = np.linalg.eigh(kernel(chosen, self.marks).astype(np.float64))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        size = root.shape[1] + 1
        gram, right = np.zeros((size, size)), np.zeros((size, len(self.langs)))
        for text, lang in rows():
            if not _LETTER.search(text):
                continue
            windows = windows_of(cleaned(text), width)
            weight = 1 / (count[lang] * len(windows))  # each language as much as another, and each text in it
            target = np.where(np.array(self.langs) == lang, 1.0, -1.0)
            for i in range(0, len(windows), batch):
                x = self.features(windows[i : i + batch], root)
                gram += weight * x.T @ x
                right += weight * np.outer(x.sum(axis=0), target)
        solved = np.linalg.solve(gram + ridge * np.eye(size), right)
        self.weights, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def features(self, windows: list[str], root: np.ndarray) -> np.ndarray:
        """The windows in the Nyström space, and a constant."""
        return np.hstack((kernel(presence(windows), self.marks) @ root, np.ones((len(windows), 1))))

    def scores(self, texts: list[str | None], batch: int = 64) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        windows = [windows_of(cleaned(texts[i]), self.width) for i in lettered]
        flat = [w for ws in windows for w in ws]
        size = np.array([len(w) for w in flat], np.float64)
        found = [kernel(presence(flat[i : i + batch]), self.marks) @ self.weights + self.bias for i in range(0, len(flat), batch)]
        if not found:
            return out
        begin = np.cumsum([0, *(len(ws) for ws in windows)])[:-1]
        mean = np.add.reduceat(np.concatenate(found) * size[:, None], begin) / np.add.reduceat(size, begin)[:, None]
        best = mean.argmax(axis=1)
        sure = np.clip((mean[np.arange(len(best)), best] + 1) / 2, 0, 1)
        for i, k, s in zip(lettered, best.tolist(), sure.tolist(), strict=True):
            out[i] = (self.langs[k], s)
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, landmarks: int = 64, ridge: float = 1e-3, width: int = 2000) -> Model:
    """Learns from labelled rows: a bounded sample of them."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model(lambda: iter(()), landmarks, ridge, width)
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, (1 << 30) * 2 * per_language // n))])
    few = rows.filter(spread <= F.coalesce(F.element_at(share, F.col("lang")), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    sample = cut(few.withColumn("n", place).filter(F.col("n") <= per_language), "language-sample")
    held = sample.orderBy("n", "lang").select("text", "lang")
    model = Model(lambda: ((r[0], r[1]) for r in held.toLocalIterator()), landmarks, ridge, width)
    discard(sample)
    return model


@own_names
def identify(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows and columns of docs with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(rows) -> dict:
        found = sent.value.scores(rows.column(text_col).to_pylist())
        return {"lang_pred": [a for a, _ in found], "score": [b for _, b in found]}

    return add_columns(without(docs, ADDED), compute, {"lang_pred": "string", "score": "double"}, () if keep_text else (text_col,), text_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    found = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out.alias("held_out"), *ADDED)
