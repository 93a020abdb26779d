"""Decisions of finished labelling runs, bucketed by key.

Below the folder of a store, ``runs`` has a folder of bucketed and sorted Parquet files per written run, and ``finished`` a JSON
line per finished one. A run counts from that line on, so what a failed run left behind is never read. A line also names the folders that it
replaces: an earlier writing of the same run, or all that a compaction brought together. Replaced folders stay until the owner
of the store empties them, and a reader that started before goes on reading them. A store has one writer at a time.

``decisions`` is a bucketed table, so a join on ``key`` reads it where it lies: only the other side is shuffled, into as many
partitions as there are buckets. A bucket holds one row per key and run, so a row that is copied many times makes no
bucket larger than others.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
DECISIONS = "key string, judge_label string, judge_confidence string"
FINISHED = "run_id string, folder string, replaces array<string>, buckets int, holds array<string>"


def finished_runs(spark: SparkSession, path: str) -> list[Row]:
    """The finished runs whose folders are not replaced, oldest first; a row per run since the last compaction."""
    try:
        lines = spark.read.schema(FINISHED).json(f"{path.rstrip('/')}/finished")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    gone = lines.select(F.explode("replaces").alias("folder"))
    return lines.join(gone, "folder", "left_anti").orderBy("folder").collect()


def bucket_count(spark: SparkSession, path: str) -> int:
    """The number of buckets of the store; a store without runs has ``BUCKETS``."""
    runs = finished_runs(spark, path)
    return runs[0].buckets if runs else BUCKETS


def add_run(decided: DataFrame, path: str, run_id: str, buckets: int = BUCKETS) -> None:
    """Add the decisions of a run (rows with a label); the same run again replaces the one before.

    The first run sets the number of buckets for the store. Repeated keys become one.
    """
    runs = finished_runs(decided.sparkSession, path)
    one = F.max(F.struct("judge_label", "judge_confidence")).alias("one")
    rows = decided.where(F.col("judge_label").isNotNull()).groupBy("key").agg(one).select("key", "one.*")
    _write(rows, path, run_id, [r.folder for r in runs if r.run_id == run_id], runs[0].buckets if runs else buckets, [])


def compact(spark: SparkSession, path: str, run_id: str = "compacted") -> None:
    """Bring all finished runs together as one, with one file per bucket; of a repeated key the later run's decision stays."""
    runs = finished_runs(spark, path)
    if len(runs) < 2:
        return
    last = F.max(F.struct("folder", "judge_label", "judge_confidence")).alias("last")
    rows = _table(spark, path, runs).groupBy("key").agg(last).select("key", "last.judge_label", "last.judge_confidence")
    held = {run for r in runs for run in (r.holds or [r.run_id])}
    _write(rows, path, run_id, [r.folder for r in runs], runs[0].buckets, sorted(held))


def decisions(spark: SparkSession, path: str, apart_from: str | None = None) -> DataFrame:
    """``key, judge_label, judge_confidence`` of the runs that are finished now, ``apart_from`` the run that is being written again.

    A run that a compaction holds cannot be told apart any more and cannot be written again.
    """
    runs = finished_runs(spark, path)
    if any(apart_from in r.holds for r in runs):
        raise ValueError(f"run {apart_from} is finished and compacted")
    return _table(spark, path, [r for r in runs if apart_from is None or r.run_id != apart_from]).drop("folder")


def _write(rows: DataFrame, path: str, run_id: str, replaces: list[str], buckets: int, holds: list[str]) -> None:
    spark = rows.sparkSession
    # Folders sort by the time of their writing.
    folder = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    staging = f"staging_{uuid.uuid4().hex}"
    try:
        # Partitions and buckets use the same hash, so each bucket is one file.
        bucketed = rows.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key")
        bucketed.option("path", f"{path.rstrip('/')}/runs/folder={folder}").saveAsTable(staging)
    finally:
        # The table is external: its files stay.
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
    line = spark.createDataFrame([(run_id, folder, replaces, buckets, holds)], FINISHED)
    line.coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/finished")


def _table(spark: SparkSession, path: str, runs: list[Row]) -> DataFrame:
    """A table of the session's catalog over just these runs, named by them, so equal calls share one."""
    base = path.rstrip("/").replace("\\", "\\\\").replace("'", "\\'")
    name = "runs_" + hashlib.sha256("\n".join([path, *(r.folder for r in runs)]).encode()).hexdigest()[:32]
    if not spark.catalog.tableExists(name):
        buckets = runs[0].buckets if runs else BUCKETS
        spark.sql(
            f"CREATE TABLE {name} ({DECISIONS}, folder string) USING parquet PARTITIONED BY (folder) "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{base}/runs'"
        )
        if runs:
            parts = " ".join(f"PARTITION (folder = '{r.folder}') LOCATION '{base}/runs/folder={r.folder}'" for r in runs)
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
    return spark.table(name)
