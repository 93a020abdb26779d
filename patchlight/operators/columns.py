"""Columns that are dear to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_keys(*tables: DataFrame) -> list[str]:
    """The column that tells files apart in all the tables; names may repeat, so without it the caller has to say."""
    if all("file_id" in t.columns for t in tables):
        return ["file_id"]
    raise ValueError("name the columns that identify a file, or give both tables a file_id")


def with_columns_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, whatever is done with them later.

    A filter on a projected column is moved below the projection with the whole
    expression in it, which then runs in the filter and again in the projection. The
    output of a generator is not: here an array of one struct, taken apart again.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(values)))
