"""Roll-ups of findings per category, file and review."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.labels import heuristic_label
from patchlight.functions.text import line_chunks
from patchlight.operators.columns import file_keys
from patchlight.operators.distributions import counts_map, in_summary_order
from patchlight.operators.filters import actionable
from patchlight.sources.changed_files import with_patch

FILE_KEYS = ["review_key", "filename"]
FINDING_FIELDS = ["category", "confidence", "feedback", "chunk", "chunk_index", "filename", "language"]


def files_per_category(findings: DataFrame, *keys: str) -> DataFrame:
    """Distinct files of each issue category as rows, with their number of issues."""
    return actionable(findings).groupBy(*keys, "category", "filename").agg(
        F.count(F.lit(1)).alias("n")
    )


def summary(findings: DataFrame, *keys: str, width: int = C.FILE_LIST_CHARS) -> DataFrame:
    """Issues, files and the start of the sorted file list per category, in report order.

    The list is shown ``width`` characters wide. The names are distinct and all but one
    have at least a character, so the first ``width / 3 + 2`` names always fill it; only
    these are gathered (each task keeps its own smallest names before the shuffle). The
    complete list is the table of ``files_per_category``.
    """
    per_file = files_per_category(findings, *keys)
    group = [*keys, "category"]
    enough = math.ceil(width / 3) + 2
    counts = per_file.groupBy(*group).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_files")
    )
    # The count stays in the struct so that both branches read one and the same exchange.
    file = F.struct("filename", "n")
    names = F.transform(F.array_sort(F.collect_list(file)), lambda f: f["filename"])
    shown = (
        per_file.withColumn(
            "place", F.row_number().over(Window.partitionBy(*group).orderBy("filename"))
        )
        .where(F.col("place") <= enough)
        .groupBy(*group)
        .agg(F.substring(F.array_join(names, ", "), 1, width).alias("files"))
    )
    return in_summary_order(counts.join(shown, group), *keys)


def _finding_struct(values: dict[str, Column]) -> Column:
    return F.struct(*[values[f].alias(f) for f in FINDING_FIELDS])


def label_files(
    files: DataFrame,
    max_lines: int = C.MAX_CHUNK_LINES,
    keywords: dict[str, list[str]] = C.HEURISTIC_KEYWORDS,
) -> DataFrame:
    """Each file that has a patch, with its findings in chunk order, by keywords and without comments.

    The chunks of a file come from one cell, so they are labelled in place: no row is
    moved, and a file without chunks keeps an empty list.
    """
    chunked = with_patch(files).withColumn("_chunks", line_chunks(F.col("patch"), max_lines))

    def finding(chunk: Column, index: Column) -> Column:
        return _finding_struct(
            {
                "category": heuristic_label(chunk, keywords),
                "confidence": F.lit(0.0),
                "feedback": F.lit(""),
                "chunk": chunk,
                "chunk_index": index,
                "filename": F.col("filename"),
                "language": F.col("language"),
            }
        )

    return chunked.select(
        *FILE_KEYS, "language", "additions", "deletions",
        F.transform("_chunks", finding).alias("findings"),
    )


def nest_findings(files: DataFrame, findings: DataFrame, *keys: str) -> DataFrame:
    """Each file that has a patch, with its findings in chunk order; one without any keeps an empty list.

    ``keys``, by default ``file_id``, identify a file in both tables: landed records may repeat a name or lack it. A
    group is one file, whose text came from a single cell, so a list is never larger than the input row it
    goes back to.
    """
    on = list(keys) or file_keys(files, findings)
    item = F.struct(
        F.col("chunk_index").alias("_order"),
        _finding_struct({f: F.col(f) for f in FINDING_FIELDS}).alias("finding"),
    )
    lists = findings.groupBy(*on).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda i: i["finding"]).alias("findings")
    )
    kept = [*FILE_KEYS, "language", "additions", "deletions"]
    rows = with_patch(files).select(*dict.fromkeys([*on, *kept])).join(lists, on, "left")
    empty = F.array().cast(lists.schema["findings"].dataType)
    return rows.select(*kept, F.coalesce("findings", empty).alias("findings"))


def review_totals(file_results: DataFrame) -> DataFrame:
    """Files, chunks, issues and the counts per category of each review."""
    def in_category(category: str) -> Column:
        return F.sum(F.size(F.filter("findings.category", lambda c: c == category)))

    counts = file_results.groupBy("review_key").agg(
        F.count(F.lit(1)).alias("n_files"), *[in_category(c).alias(c) for c in C.CATEGORIES]
    )
    issues = sum((F.col(c) for c in C.CATEGORIES[1:-1]), F.col(C.CATEGORIES[0]))
    return counts.select(
        "review_key",
        "n_files",
        (issues + F.col("ok")).alias("total_chunks"),
        issues.alias("total_issues"),
        counts_map().alias("category_counts"),
    )


def review_results(file_results: DataFrame) -> DataFrame:
    """The result of each review as rows ``review_key, kind, file, totals``.

    A review has one row of kind ``file`` per file, with the file and its findings, and one row of kind ``totals``
    with its number of files, chunks and issues and its counts per category. The shape is the same for a review of one
    file and of a million: no cell grows with the review, no file is moved, and the totals are
    counted once. ``file_results`` is read twice, so pass a written table.
    """
    file = F.struct("filename", "language", "additions", "deletions", "findings")
    totals = F.struct("n_files", "total_chunks", "total_issues", "category_counts")
    files = file_results.select("review_key", F.lit("file").alias("kind"), file.alias("file"))
    sums = review_totals(file_results).select("review_key", F.lit("totals").alias("kind"), totals.alias("totals"))
    return files.unionByName(sums, allowMissingColumns=True)


def result_json(results: DataFrame) -> DataFrame:
    """``review_key, kind, filename, json``: one document per file, and one with the totals."""
    document = F.coalesce(F.to_json("file"), F.to_json("totals"))
    return results.select("review_key", "kind", F.col("file.filename").alias("filename"), document.alias("json"))


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested results as JSON lines."""
    results.write.mode(mode).json(path)
