"""Counts over the category domain.

The domain has five values, so a count over it is five conditional counts in one
aggregate: each task sends one row, no key is hot, and a category that does not
occur still has its 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.labels import category_array


def conditional_counts(category: Column) -> list[Column]:
    return [F.count_if(category == c).alias(c) for c in C.CATEGORIES]


def as_rows(counts: DataFrame, *keys: str) -> DataFrame:
    """Turn the five count columns into rows ``category, idx, n``."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.lit(i).alias("idx"), F.col(c).alias("n"))
            for i, c in enumerate(C.CATEGORIES)
        ]
    )
    return counts.select(*keys, F.inline(pairs))


def counts_map() -> Column:
    """The five count columns as one map."""
    return F.create_map(*[x for c in C.CATEGORIES for x in (F.lit(c), F.col(c))])


def category_counts(findings: DataFrame, *keys: str, category: str = "category") -> DataFrame:
    """Rows ``category, idx, n`` for all five categories, over everything or per key."""
    totals = findings.groupBy(*keys).agg(*conditional_counts(F.col(category)))
    return as_rows(totals, *keys)


def category_dimension(rows: DataFrame) -> DataFrame:
    """The five categories with their index."""
    values = ", ".join(f"('{c}', {i})" for i, c in enumerate(C.CATEGORIES))
    return rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(category, idx)")


def zero_fill(counts: DataFrame, value: str = "n") -> DataFrame:
    """Complete a table of counts per category to all five."""
    return category_dimension(counts).join(counts, "category", "left").select(
        "category", "idx", F.coalesce(value, F.lit(0)).alias(value)
    )


def totals(findings: DataFrame, *keys: str) -> DataFrame:
    """Number of chunks and of chunks with an issue."""
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(F.col("category") != "ok").alias("total_issues"),
    )


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Frequency of the values, missing ones left out, the most frequent first."""
    return (
        rows.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def shown_counts(counts: DataFrame) -> DataFrame:
    """The counts a summary bar shows: issues only, zeros left out."""
    return counts.where((F.col("category") != "ok") & (F.col("n") > 0))


def first_per_category(rows: DataFrame, label: str, order: str, columns: list[str]) -> DataFrame:
    """The first row of each category by the unique ``order`` column, with the class size.

    Five conditional minima in one aggregate: no sort, and each task sends one row.
    """
    row = F.struct(*columns)
    picks = [
        F.struct(
            F.lit(c).alias("category"),
            F.count_if(F.col(label) == c).alias("n"),
            F.min_by(row, F.when(F.col(label) == c, F.col(order))).alias("row"),
        )
        for c in C.CATEGORIES
    ]
    samples = rows.agg(F.array(*picks).alias("samples")).select(F.inline("samples"))
    return samples.where(F.col("n") > 0).select("category", "n", "row.*")


def in_summary_order(rows: DataFrame, *keys: str, category: str = "category") -> DataFrame:
    """Rows of the summary categories in their fixed order, within each of the ``keys``."""
    order = F.array(*[F.lit(c) for c in C.SUMMARY_ORDER])
    return (
        rows.withColumn("ord", F.array_position(order, F.col(category)))
        .where(F.col("ord") > 0)
        .orderBy(*keys, "ord")
    )


def in_index_order(rows: DataFrame, category: str = "category") -> DataFrame:
    return rows.orderBy(F.array_position(category_array(), F.col(category)))
