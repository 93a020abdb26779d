"""Review of changed files: chunks, categories, comments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.operators.chunks import explode_chunks
from patchlight.operators.classifier import apply_fallback, classify
from patchlight.operators.findings import attach_feedback, label_by_keywords
from patchlight.operators.rollups import label_files, nest_findings, review_results
from patchlight.sources.changed_files import from_pr_files, latest_landing, with_patch
from patchlight.sources.tables import materialise, with_row_id

Labeller = Callable[[DataFrame], DataFrame]


def by_keywords(keywords: dict[str, list[str]] = C.HEURISTIC_KEYWORDS) -> Labeller:
    return lambda chunks: label_by_keywords(chunks, keywords)


def by_model(model: PipelineModel, fallback_below: float | None = None) -> Labeller:
    """Label with a trained classifier whose text column is ``chunk``."""

    def label(chunks: DataFrame) -> DataFrame:
        scored = classify(chunks, model)
        return scored if fallback_below is None else apply_fallback(scored, fallback_below)

    return label


def find(
    files: DataFrame, label: Labeller | None = None, max_lines: int = C.MAX_CHUNK_LINES
) -> DataFrame:
    """One row per chunk of every file that has a patch, with category and confidence.

    Scan, cut and label in one stage; the same code runs on a stream.
    """
    return (label or by_keywords())(explode_chunks(with_patch(files), max_lines))


def review(
    files: DataFrame,
    replies: DataFrame,
    label: Labeller | None = None,
    max_lines: int = C.MAX_CHUNK_LINES,
) -> DataFrame:
    """The findings table: ``find`` plus the recorded comment of each chunk."""
    return attach_feedback(find(files, label, max_lines), replies)


def respond(
    records: DataFrame,
    replies: DataFrame | None = None,
    label: Labeller | None = None,
    max_lines: int = C.MAX_CHUNK_LINES,
    keywords: dict[str, list[str]] = C.HEURISTIC_KEYWORDS,
) -> DataFrame:
    """From landed records to the response of each review (``rollups.review_results``).

    ``label`` gives category and confidence, a model's for example, and ``replies`` the comments; without both the
    keywords label the chunks in place. Records that know their ``landing`` count by the last one of their review. Files are told apart by
    ``file_id``, which goes with them from the record to the response; records without it get one from their place in a
    written table. Files without a patch are no part of a response, and a review without any file to look at has none; it is
    a row of ``changed_files.without_reviewable_file``. The labelled files are written to the shared folder.
    """
    files = with_patch(from_pr_files(records))
    if "landing" in files.columns:
        files = latest_landing(files)
    if label is None and replies is None:
        return review_results(materialise(label_files(files, max_lines, keywords), "file-results"))
    if "file_id" not in files.columns:
        files = with_row_id(materialise(files, "files")).withColumnRenamed("row_id", "file_id")
    found = find(files, label or by_keywords(keywords), max_lines)
    found = found.withColumn("feedback", F.lit("")) if replies is None else attach_feedback(found, replies)
    return review_results(materialise(nest_findings(files, found), "file-results"))
