"""Classification metrics, all from one table of confusion counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.labels import category_index
from patchlight.operators.distributions import category_dimension


def pool(*predictions: DataFrame) -> DataFrame:
    """Predictions of all folds in one table."""
    return reduce(DataFrame.unionByName, predictions)


def confusion(predictions: DataFrame, *keys: str) -> DataFrame:
    """``label, prediction, n``, at most 25 rows per key."""
    return predictions.groupBy(*keys, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def cross_entropy(scored: DataFrame, *keys: str, probabilities: str = "p") -> DataFrame:
    """``loss``: mean of -ln of the probability of the label's class, weighted by ``weight``, without any penalty.

    The same for a training and a validation part; ``scored`` has ``label, weight`` and five probabilities. Rows with a label outside
    the domain have no loss. A class that is held impossible but occurs gives an infinite loss.
    """
    of_label = F.get(F.col(probabilities), category_index(F.col("label")))
    loss = F.when(of_label > 0, -F.log(of_label)).when(of_label == 0, F.lit(float("inf")))
    known = F.when(loss.isNotNull(), F.col("weight"))
    return scored.groupBy(*keys).agg((F.sum(loss * F.col("weight")) / F.sum(known)).alias("loss"))


def accuracy(predictions: DataFrame, *keys: str) -> DataFrame:
    hit = F.coalesce(F.col("label") == F.col("prediction"), F.lit(False))
    return predictions.groupBy(*keys).agg(F.avg(hit.cast("int")).alias("accuracy"))


def class_counts(counts: DataFrame, *keys: str) -> DataFrame:
    """True positives, support and number of predictions of each class that occurs."""
    same = F.col("label") == F.col("prediction")
    sides = F.array(
        F.struct(
            F.col("label").alias("category"),
            F.when(same, F.col("n")).otherwise(0).alias("tp"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
        ),
        F.struct(
            F.col("prediction").alias("category"),
            F.lit(0).cast("bigint").alias("tp"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    return (
        counts.select(*keys, F.inline(sides))
        .groupBy(*keys, "category")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )


def _ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _scored(classes: DataFrame) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return (
        classes.withColumn("precision", _ratio(tp, predicted))
        .withColumn("recall", _ratio(tp, support))
        .withColumn("f1", _ratio(2 * tp, support + predicted))
    )


def macro_f1(predictions: DataFrame, *keys: str) -> DataFrame:
    """Mean F1 over the classes seen in the labels or the predictions of the key."""
    classes = class_counts(confusion(predictions, *keys), *keys)
    return _scored(classes).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """``fold, accuracy, macro_f1`` from one pass over the predictions."""
    scored = _scored(class_counts(confusion(predictions, "fold"), "fold"))
    return scored.groupBy("fold").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )


def summarise_folds(metrics: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the folds."""
    return metrics.agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.stddev_pop("macro_f1").alias("std_macro_f1"),
    )


def classification_report(predictions: DataFrame) -> DataFrame:
    """``name, precision, recall, f1, support``: the five classes, accuracy and the averages."""
    seen = class_counts(confusion(predictions))
    five = _scored(
        category_dimension(predictions)
        .join(seen, "category", "left")
        .na.fill(0, ["tp", "support", "predicted"])
    )
    row = F.struct(
        F.col("category").alias("name"), "precision", "recall", "f1", "support", F.col("idx").alias("ord")
    )
    parts = ("precision", "recall", "f1")
    n = F.sum("support")
    hits = _ratio(F.sum("tp"), n)

    def summary(name: str, values: list[Column], place: int) -> Column:
        named = [v.alias(p) for v, p in zip(values, parts)]
        return F.struct(
            F.lit(name).alias("name"), *named, n.alias("support"), F.lit(place).alias("ord")
        )

    # The classes are five rows, so the averages and the rows themselves fit one aggregate.
    report = five.agg(
        F.concat(
            F.collect_list(row),
            F.array(
                summary("accuracy", [hits, hits, hits], len(C.CATEGORIES)),
                summary("macro avg", [F.avg(p) for p in parts], len(C.CATEGORIES) + 1),
                summary(
                    "weighted avg",
                    [_ratio(F.sum(F.col(p) * F.col("support")), n) for p in parts],
                    len(C.CATEGORIES) + 2,
                ),
            ),
        ).alias("lines")
    )
    return report.select(F.inline("lines")).orderBy("ord").drop("ord")
