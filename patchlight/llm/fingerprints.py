"""Document fingerprints: threshold-scaled sketches of word shingles.

A shingle is the hash of five words in a row (of all words, where there are fewer). A fingerprint keeps every
distinct shingle below a fixed fraction of the hash range, whatever the length of the text, and
the smallest shingle, so that only texts without words have an empty one. Sketches of one fraction
merge (``merge``): their union less the smallest hashes that are neither below the limit nor the smallest of both. Their
overlap estimates containment even between very unequal texts.

Only column expressions run here. Null texts are empty. Documents follow one another by
descending id, with rows without an id last; where rows share an id, the next document is
the smallest of their texts. Each row is a document of its own. Two texts without words are alike (1).
An empty table gives no rows. A text is hashed whole, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchlight.llm.common import text_of, written

SHINGLE = 5
SCALE = 4  # one of so many hashes is kept
LOWEST = -(1 << 63)
NO_ID = LOWEST


def limit_of(scale: int) -> int:
    """The largest hash that is kept."""
    return LOWEST + (1 << 64) // scale - 1


def with_sketch(rows: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """``rows`` with the sketch of a text column: ascending distinct hashes."""
    limit = limit_of(scale)
    hashed = F.transform(F.array_remove(F.split(text, r"[ \t-\r]+"), ""), lambda word: F.xxhash64(word))
    rows = rows.withColumn("_words", hashed)
    shingles = (
        F.when(
            F.size("_words") >= SHINGLE,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - SHINGLE),
                lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(SHINGLE)]),
            ),
        )
        .when(F.size("_words") > 0, F.array(F.xxhash64("_words")))
        .otherwise(F.array().cast("array<bigint>"))
    )
    rows = rows.withColumn("_shingles", shingles).drop("_words")
    low = F.filter("_shingles", lambda h: h <= F.lit(limit))
    least = F.filter(F.array(F.array_min("_shingles")), lambda h: h.isNotNull())
    return rows.withColumn(name, F.array_sort(F.array_union(low, least))).drop("_shingles")


def as_text(sketch: str) -> Column:
    return F.concat_ws("", F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingles of two texts."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: str, b: str) -> Column:
    """Estimated share of the shingles of the first text that the second holds."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: str, b: str, scale: int = SCALE) -> Column:
    """The sketch of all shingles of two texts, from their sketches of the same scale."""
    both = F.array_sort(F.array_union(a, b))
    least = F.array_min(both)
    return F.filter(both, lambda h: (h <= F.lit(limit_of(scale))) | (h == least))


def followers(texts: DataFrame) -> DataFrame:
    """For each key of ``texts`` (key, text): the key before it in descending order, and how much that one takes.

    Keys are dealt into ranges, which are numbered in a written table; each range looks at its own keys,
    and the first key of the next range (one row per range) closes the gaps.
    """
    spark = texts.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = texts.groupBy("key").agg(F.max(F.length("text")).alias("n"))
    dealt = sizes.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id())
    keys = written(dealt, "ranges").select("range", F.struct("key", "n").alias("at"))
    firsts = keys.groupBy("range").agg(F.min("at").alias("first"))  # as many rows as ranges
    in_order = W.orderBy("range")
    least = F.first("first").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    gaps = firsts.select("range", F.coalesce(F.lead("first").over(in_order), least).alias("after"))
    inside = keys.withColumn("next", F.lead("at").over(W.partitionBy("range").orderBy("at")))
    joined = inside.join(F.broadcast(gaps), "range")
    taker = F.coalesce("next", "after")
    return joined.select(
        F.col("at.key").alias("key"), taker["key"].alias("taker"), F.floor(taker["n"] / 2).cast("int").alias("taken")
    )


def fingerprint(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of all rows of ``docs`` (doc_id, text) and of their edited texts, and how alike they are.

    The edited text has its second half (``floor(n / 2)`` code points) replaced by as many from the start of the next document.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), text_of().alias("text"))
    # Both joins start from this exchange of whole texts by key; it is computed once.
    given = with_sketch(texts.join(followers(texts), "key"), "text", "next_sketch", scale)
    heads = given.select(
        F.col("taker").alias("key"), F.struct(F.expr("substring(text, 1, taken)").alias("head"), "next_sketch").alias("next")
    )
    heads = heads.groupBy("key").agg(F.min("next").alias("next"))
    rows = texts.join(heads, "key", "left")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - half),
        F.substring(F.col("next.head"), F.lit(1), half),
    )
    rows = rows.select("key", "text", F.col("next.next_sketch").alias("next_sketch"), edited.alias("edited"))
    rows = with_sketch(with_sketch(rows, "text", "sketch", scale), "edited", "edited_sketch", scale)
    return rows.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
