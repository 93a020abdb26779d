"""Token counts through a cache of digests.

A text is known by the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its file
and of the options used. The cache is a Parquet table (content, n_tokens), one folder per
tokenizer. A run finds the distinct contents that the cache lacks, encodes only those, appends
them, and joins every document with the cache.

Null and empty texts count 0 tokens. Equal texts share one cache row, and rows that two runs appended for the
same content count once. Rows without an id, repeated rows and rows of one id are counted each by itself; an empty
table gives no rows. Extra columns of the input are ignored. A text is encoded whole, in one task. An append is one commit, so a run
that fails leaves the cache as it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import batches, load_tokenizer, shared_folder, text_of, written

CACHE_SCHEMA = "content binary, n_tokens bigint"
TOKENIZER = "byte_bpe_50k.json"
OPTIONS = "add_special_tokens=False, no truncation, no padding"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + OPTIONS.encode()).hexdigest()


def encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns batches (content, norm) into rows of the cache."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        for part in parts:
            counts = [
                len(encoding)
                for texts in batches(part.column("norm").to_pylist())
                for encoding in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("content").cast(pa.binary()), pa.array(counts, pa.int64())],
                names=["content", "n_tokens"],
            )

    return encode


def count_tokens(
    docs: DataFrame,
    cache: str,
    tokenizer_path: str | None = None,
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs`` (doc_id, text).

    ``cache`` is a folder that may not exist yet. ``normalise`` must not change what the
    tokenizer returns; for byte-level tokenizers that is only the identity.
    """
    spark = docs.sparkSession
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    folder = f"{cache.rstrip('/')}/tokenizer={tokenizer_version(path)}"
    keyed = docs.select("doc_id", text_of().alias("norm")).select(
        "doc_id",
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.unhex(F.sha2(normalise(F.col("norm")), 256)).alias("content"),
        normalise(F.col("norm")).alias("norm"),
    )
    # Copies collapse inside each task, before their texts are moved.
    distinct = keyed.select("content", "norm").dropDuplicates(["content"])
    known = _read(spark, folder)
    misses = distinct if known is None else distinct.join(known, "content", "left_anti")
    misses.mapInArrow(encoder(path), CACHE_SCHEMA).write.mode("append").parquet(folder)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(folder).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # A plain table below the join, so that a hot content can be split.
    counts = written(counts, "token-counts")
    return keyed.drop("norm").join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")


def _read(spark, folder: str) -> DataFrame | None:
    """The cached rows, or None before the first run."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def over_limit_counts(docs: DataFrame, limit: int = 512, cache: str | None = None) -> DataFrame:
    """The counts with a flag for documents of more than ``limit`` tokens; without ``cache`` it starts empty."""
    counts = count_tokens(docs, cache or shared_folder(docs.sparkSession, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
