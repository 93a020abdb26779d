"""Review of files as they land.

The steps before the sink are stateless and the same as in the batch job. The findings
go to Spark's own file sink, which keeps a log of its finished batches: a batch repeated
after a failure is not written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patchlight import constants as C
from patchlight import schemas
from patchlight.plans.review import Labeller, find
from patchlight.sources.changed_files import latest_landing


def landing_folder(
    spark: SparkSession,
    path: str,
    format: str = "json",
    schema: str = schemas.PR_FILES,
    files_per_batch: int | None = None,
    **options: str,
) -> DataFrame:
    """Stream of the records of a folder; ``files_per_batch`` bounds a batch."""
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def write_findings(
    files: DataFrame,
    path: str,
    checkpoint: str,
    label: Labeller | None = None,
    max_lines: int = C.MAX_CHUNK_LINES,
) -> StreamingQuery:
    """Append the findings of all files there are, then stop; run again for new ones."""
    return (
        find(files, label, max_lines)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def count_findings(spark: SparkSession, path: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Count the findings that have come to ``path`` since the last run, per ``keys`` and category, then stop.

    The counts are kept in the state store below ``checkpoint``, so a run reads the new files of the findings only, their
    columns of keys and categories alone, and goes on where the last one stopped, also where that one failed: the sink's log hides
    unfinished batches, and a repeated batch starts from the state before it. There is nothing else to write: ``running_counts`` reads
    the state itself. The state grows with the number of keys, not with the findings.
    """
    schema = ", ".join(f"{name} string" for name in [*keys, "category"])
    findings = spark.readStream.schema(schema).parquet(path)
    return (
        findings.groupBy(*keys, "category")
        .agg(F.count(F.lit(1)).alias("n"))
        .writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counts after the last finished batch of ``count_findings``."""
    return spark.read.format("statestore").load(checkpoint).select("key.*", F.col("value.count").alias("n"))


def current_counts(spark: SparkSession, checkpoint: str, *keys: str) -> DataFrame:
    """The counts of each review's last landing, for counts kept by ``review_key, landing``, summed up per ``keys`` and category."""
    current = latest_landing(running_counts(spark, checkpoint))
    return current.groupBy(*keys, "category").agg(F.sum("n").alias("n"))
