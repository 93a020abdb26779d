"""Findings: a category and a review comment for every chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.display import (
    code_preview,
    confidence_text,
    display_name,
    feedback_or_reason,
    percent,
    percent_even,
    plain_feedback,
)
from patchlight.functions.labels import heuristic_label
from patchlight.functions.prompts import feedback_prompt
from patchlight.functions.text import content_key
from patchlight.operators.columns import with_columns_once
from patchlight.operators.filters import actionable
from patchlight.operators.relabel import latest_replies


def label_by_keywords(
    chunks: DataFrame, keywords: dict[str, list[str]] = C.HEURISTIC_KEYWORDS
) -> DataFrame:
    """Category by keyword hits; the confidence of a heuristic result is 0."""
    label = heuristic_label(F.col("chunk"), keywords)
    return with_columns_once(chunks, {"category": label}).withColumn("confidence", F.lit(0.0))


def with_chunk_key(findings: DataFrame) -> DataFrame:
    """Key of a chunk: its place and its text, so a changed text asks for a new comment."""
    return findings.withColumn(
        "chunk_key", content_key("review_key", "filename", "chunk_index", "chunk")
    )


def feedback_prompts(findings: DataFrame, include_ok: bool = True) -> DataFrame:
    """``key, prompt`` for every finding, or for the actionable ones only."""
    chosen = findings if include_ok else actionable(findings)
    return with_chunk_key(chosen).select(
        F.col("chunk_key").alias("key"),
        feedback_prompt(F.col("category"), F.col("chunk")).alias("prompt"),
    )


def attach_feedback(findings: DataFrame, replies: DataFrame) -> DataFrame:
    """Add the review comment of each chunk, or the reason why there is none."""
    latest = latest_replies(replies).withColumnRenamed("key", "chunk_key")
    return (
        with_chunk_key(findings)
        .join(latest, "chunk_key", "left")
        .withColumn("feedback", feedback_or_reason(F.col("response_text"), F.col("error")))
        .drop("chunk_key", "response_text", "error", "attempts")
    )


def visible(findings: DataFrame, include_ok: bool = False) -> DataFrame:
    return findings if include_ok else actionable(findings)


def report(findings: DataFrame, include_ok: bool = False) -> DataFrame:
    """The findings as a reader sees them, one line per finding."""
    confidence = F.col("confidence")
    return visible(findings, include_ok).select(
        "review_key",
        "filename",
        (F.col("chunk_index") + 1).alias("chunk_number"),
        F.upper("category").alias("heading"),
        display_name(F.col("category")).alias("category_name"),
        percent(confidence).alias("percent"),
        percent_even(confidence).alias("percent_even"),
        confidence_text(confidence).alias("confidence_text"),
        plain_feedback(F.col("feedback")).alias("comment"),
        code_preview(F.col("chunk")).alias("preview"),
    )
