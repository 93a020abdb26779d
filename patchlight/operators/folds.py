"""Class weights and stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.labels import category_index
from patchlight.operators.distributions import as_rows, conditional_counts
from patchlight.sources.tables import materialise


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """``category, idx, n, weight`` with weight = total / (classes * n), in index order.

    A class without rows has no weight and is an error.
    """
    counted = rows.agg(*conditional_counts(F.col(label)))
    total = sum((F.col(c) for c in C.CATEGORIES[1:]), F.col(C.CATEGORIES[0]))
    table = as_rows(counted.withColumn("total", total), "total")
    weight = F.when(
        F.col("n") == 0,
        F.raise_error(F.concat(F.lit("no rows of class "), F.col("category"))).cast("double"),
    ).otherwise(F.col("total") / (len(C.CATEGORIES) * F.col("n")))
    return table.select("category", "idx", "n", weight.alias("weight"))


def attach_weights(rows: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Add the weight of its class to each row; the weights are five rows by construction.

    A label outside the five classes has no weight and its row drops out, as in ``trainable``.
    """
    table = weights.select(F.col("category").alias(label), "weight")
    return rows.join(F.broadcast(table), label)


def ranks(
    rows: DataFrame, key: str, label: str = "label", seed: int = C.FOLD_SEED
) -> DataFrame:
    """``key, place``: the place (from 0) of each row by class, then by the hash of key and seed, then by key.

    Only these three narrow columns are range-partitioned and sorted; a row's place is its number in its sorted
    partition after all rows of the partitions before. Adaptive execution cuts as many partitions as there are bytes for,
    so no class is sorted in one task at any size. The table of partition sizes is summed up in one small window and
    broadcast; it has a row per partition. Labels outside the domain count as one more class.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    order = ["_class", "_hash", "_key"]
    narrow = rows.select(
        F.coalesce(category_index(F.col(label)), F.lit(-1)).alias("_class"),
        F.coalesce(digest, F.lit("")).alias("_hash"),
        F.col(key).alias("_key"),
    )
    # The number of a row within its sorted partition is in the lower 33 bits; written, so that it is read the same ever after.
    numbered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("_key", F.monotonically_increasing_id().alias("_n"))
    ranked = materialise(numbered, "fold-ranks")
    part, within = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    placed = ranked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.select(F.col("_key").alias(key), (F.col("_before") + within).alias("place"))


def assign_folds(
    rows: DataFrame,
    key: str,
    label: str = "label",
    k: int = C.N_FOLDS,
    seed: int = C.FOLD_SEED,
) -> DataFrame:
    """Add ``fold`` (1 .. k): shuffled, each class and the whole split evenly to within one row.

    ``key`` must identify a row; ``sources.tables.with_row_id`` makes one for a table whose rows may be equal. The rows
    are dealt out in turn by their ``ranks``. The other columns are neither sorted nor ranked: a join on the key brings the
    folds back to them, and where the narrow table is small enough it is broadcast and they do not move at all.
    ``rows`` is read twice, so pass a written table where a column is dear to compute.
    """
    dealt = ranks(rows, key, label, seed).select(
        F.col(key).alias("_key"), (F.pmod("place", F.lit(k)) + 1).cast("int").alias("fold")
    )
    return rows.join(dealt, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def split_fold(rows: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of a fold."""
    return rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
