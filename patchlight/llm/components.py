"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); a component is its smallest id.

    In each round an id takes the smallest label next to it, and then the label of its label, so stars
    take two rounds and paths a number that grows with the logarithm of their length. Rounds are written, so each
    starts from a plain table and joins on a hot id can be split.
    """
    both = edges.where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(both, "edges")
    labels = links.groupBy("a").agg(F.min("b").alias("b"))
    labels = written(labels.select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), "component"), "b")
        near = near.groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "id")
        lower = labels.join(near, "id").select(
            "id", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        lower = written(lower, "labels")
        jumps = lower.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        labels = written(
            lower.join(jumps, "component").select("id", "before", F.col("beyond").alias("component")), "labels"
        )
        if labels.where("before <> component").isEmpty():
            return labels.select("id", "component")
