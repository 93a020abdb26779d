"""Cutting changed files into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.text import chunk_of, line_pieces


def explode_chunks(files: DataFrame, max_lines: int = C.MAX_CHUNK_LINES, text: str = "patch") -> DataFrame:
    """One row per chunk with its 0-based index; the other file columns are carried along."""
    others = [c for c in files.columns if c != text]
    pieces = F.posexplode(line_pieces(F.col(text), max_lines)).alias("chunk_index", "_piece")
    return files.select(*others, pieces).select(
        *others, "chunk_index", chunk_of(F.col("_piece")).alias("chunk")
    )
