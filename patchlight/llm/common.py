"""Helpers that several operators of this package use."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table ``documents``."""
    return spark.read.schema(DOCUMENTS).parquet(f"{sf}/documents.parquet")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, quality int, toxic int").parquet(f"{sf}/labels.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors reach; the session has to name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/llm-{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, with no lineage before it."""
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


@cache
def load_tokenizer(path: str) -> Any:
    """The tokenizer of a file of the tokenizers library, once per Python process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def batches(texts: list[str], limit: int = 1 << 18) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``limit`` characters."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def pack(columns: list[np.ndarray]) -> bytes:
    """64-bit columns as compressed byte planes; the first, ascending, as differences."""
    n = len(columns[0])
    first = columns[0].astype(np.uint64)
    parts = [np.diff(first, prepend=np.uint64(0)), *[c.astype(np.uint64) for c in columns[1:]]]
    planes = np.concatenate([p.view(np.uint8).reshape(n, 8).T.ravel() for p in parts]).tobytes()
    return n.to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(block: bytes, width: int) -> list[np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    planes = np.frombuffer(pa.decompress(block[8:], n * 8 * width, codec="zstd", asbytes=True), np.uint8)
    columns = [np.ascontiguousarray(planes[k * 8 * n : (k + 1) * 8 * n].reshape(8, n).T).view(np.uint64).ravel() for k in range(width)]
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns
