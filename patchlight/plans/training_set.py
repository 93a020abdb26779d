"""Training set from labelled review examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.display import code_preview
from patchlight.functions.labels import weak_label
from patchlight.functions.text import first_chars
from patchlight.operators.distributions import first_per_category
from patchlight.sources.tables import write_table


def with_patch_rows(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples with a patch, and the others with the reason of their rejection."""
    return (
        examples.where(F.col("patch").isNotNull()),
        examples.where(F.col("patch").isNull()).withColumn("reason", F.lit("no patch")),
    )


def build_training_set(
    examples: DataFrame,
    patterns: dict[str, list[str]] = C.WEAK_LABEL_PATTERNS,
    max_chars: int = C.MAX_PATCH_CHARS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``code, label, original_label, repo, pr_number`` of all examples that have a patch.

    Every output is a function of its own row, so this is a scan and a write. ``keep``
    names further columns to carry along, such as a row number of the source.
    """
    return with_patch_rows(examples)[0].select(
        *keep,
        first_chars(F.col("patch"), max_chars).alias("code"),
        weak_label(F.col("explanation"), F.col("label"), patterns).alias("label"),
        F.col("label").alias("original_label"),
        "repo",
        "pr_number",
    )


def write_training_set(
    examples: DataFrame, path: str, patterns: dict[str, list[str]] = C.WEAK_LABEL_PATTERNS, format: str = "parquet"
) -> dict[str, int]:
    """Write the training set; the counts come from the one pass that reads the examples and writes it.

    ``examples`` and ``rejected`` count the input and its rows without a patch, and each category its written rows.
    """
    read, kept = Observation(), Observation()
    observed = examples.observe(
        read, F.count(F.lit(1)).alias("examples"), F.count_if(F.col("patch").isNull()).alias("rejected")
    )
    training = build_training_set(observed, patterns).observe(
        kept, *[F.count_if(F.col("label") == name).alias(name) for name in C.CATEGORIES]
    )
    write_table(training, path, format)
    return read.get | kept.get


def sample_check(training: DataFrame, order: str) -> DataFrame:
    """The first row of each category, with the class size and the start of its code."""
    samples = first_per_category(training, "label", order, [order, "repo", "code"])
    return samples.select("category", "n", order, "repo", code_preview(F.col("code")).alias("preview"))
