"""Row filters and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.labels import is_category
from patchlight.operators.columns import file_keys
from patchlight.sources.changed_files import with_patch


def with_code(rows: DataFrame, code: str = "code") -> DataFrame:
    """Rows that have code; an empty cell is a missing one."""
    return rows.where(F.col(code) != "")


def trainable(rows: DataFrame, code: str = "code", label: str = "judge_label") -> DataFrame:
    """Rows with code and a label of the domain; unread replies drop out here too."""
    return with_code(rows, code).where(is_category(F.col(label)))


def unlabelled_columns(rows: DataFrame) -> DataFrame:
    """Add the still empty label columns."""
    empty = F.lit(None).cast("string")
    return rows.withColumn("judge_label", empty).withColumn("judge_confidence", empty)


def pending(rows: DataFrame) -> DataFrame:
    """Rows still to label."""
    return rows.where(F.col("judge_label").isNull())


def parsed(rows: DataFrame) -> DataFrame:
    """All rows but the ones whose reply was unreadable; pending rows stay."""
    return rows.where(~F.col("judge_label").eqNullSafe(C.PARSE_FAILED))


def high_confidence(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("judge_confidence") == "high")


def actionable(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("category") != "ok")


def clean_files(files: DataFrame, findings: DataFrame, *keys: str) -> DataFrame:
    """Files with a patch but no actionable finding, those without any chunk included.

    Each file is judged by itself: ``keys``, by default ``file_id``, identify it in both tables.
    """
    on = list(keys) or file_keys(files, findings)
    return with_patch(files).join(actionable(findings).select(*on).distinct(), on, "left_anti")


def finding_problem() -> Column:
    """What is wrong with a finding, NULL if nothing."""
    required = ["filename", "language", "chunk_index", "chunk", "confidence", "feedback"]
    problem = F.when(
        ~F.coalesce(is_category(F.col("category")), F.lit(False)), F.lit("unknown category")
    )
    for name in required:
        problem = problem.when(F.col(name).isNull(), F.lit(f"missing {name}"))
    return problem


def split_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid findings, and the others with a reason."""
    problem = finding_problem()
    return (
        findings.where(problem.isNull()),
        findings.withColumn("reason", problem).where(F.col("reason").isNotNull()),
    )
