"""The corpus pipeline: stages that each write their documents, which the next one reads.

All stages take null texts as empty, keep null ids, treat rows repeated in all columns as copies of one text, and give an
empty table for an empty one; extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isobar.llm import decontaminate, exact_dedup, packing, quality, similar
from isobar.llm.common import cut, discard, table
from isobar.llm.tokens import public


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the highest grade is under one half: those like toxic or low-quality rated ones.

    An empty text has the score 0, so the thresholds alone decide on it; repeated rows score alike. Without ratings of two grades all stay."""
    graded = quality.grade(docs, quality.fitted(spark, sf_dir), accept=2)
    return graded.filter("selected").select(docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest id of each group of equal texts; a null id only where there is no other, and one of rows with the same id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: texts that share four fifths of their five-word shingles, or more.

    Groups are single linkage over pairs verified exactly; blank texts are one group; of rows with the smallest id one stays."""
    return similar.drop_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages contaminate: at least one word in 20 lies in an occurrence of a window. Texts without words stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' pieces into sequences of 2048 tokens; an empty text is one piece, the end id alone."""
    return packing.pack(docs, public("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the learned classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
