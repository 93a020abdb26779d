"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffles, turns joins into broadcasts only after it
# has seen the real size of a side, and splits the skewed partitions of a join.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """Session for tests and measurements on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("patchlight")
    settings = {
        **ADAPTIVE,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that every executor can reach, below ``spark.checkpoint.dir``.

    The caller's session names that folder and the caller empties it; there is no other place to write to.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{base.rstrip('/')}/patchlight-{purpose}-{uuid.uuid4().hex}"
