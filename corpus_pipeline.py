"""A corpus through five stages: rules, toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; what it learns, it learns from its own
input and the labels of ``sf_dir``. All but the last return the columns of ``documents``. ``run`` writes every stage as a table
in the shared folder and hands it to the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.llm import jaccard, packing, quality, substrings, toxicity
from patchlight.llm.common import documents, labels, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and score as the trusted ones do."""
    judged = quality.judge(docs, quality.fit(docs, labels(spark, sf_dir)))
    return judged.where("kept").select("row.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    index = toxicity.fit(docs, labels(spark, sf_dir))
    return toxicity.score_rows(docs, index).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the one of the smallest id."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur more than once."""
    return substrings.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

# Hashes, learned models and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the whole table ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
