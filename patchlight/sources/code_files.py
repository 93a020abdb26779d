"""Code files of a folder as pasted-code records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.functions.text import decode_utf8_ignore


def code_text(content: Column) -> Column:
    """Content of a text file: invalid bytes dropped, CRLF and CR read as line feeds."""
    return F.regexp_replace(decode_utf8_ignore(content), "\r\n?", "\n")


def read_code_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file below ``path``: review_key and filename are its path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.col("path").alias("review_key"),
        code_text(F.col("content")).alias("code"),
        F.col("path").alias("filename"),
    )
