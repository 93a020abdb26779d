import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.operators import distributions as D
from patchlight.operators import folds, metrics
from patchlight.sources.tables import with_row_id


def labelled(spark, sizes):
    rows = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "key int, label string")


def test_class_weights(spark):
    sizes = dict(bug=324, style=106, performance=39, security=24, ok=415)
    got = folds.class_weights(labelled(spark, sizes)).orderBy("idx").collect()
    assert [round(r.weight, 3) for r in got] == [0.560, 1.713, 4.656, 7.567, 0.438]
    assert [r.category for r in got] == C.CATEGORIES
    assert math.isclose(sum(r.n * r.weight for r in got), 908)


def test_a_class_without_rows_has_no_weight(spark):
    with pytest.raises(Exception, match="no rows of class security"):
        folds.class_weights(labelled(spark, dict(bug=1, style=1, performance=1, ok=1))).collect()


def test_fold_sizes(spark):
    folded = folds.assign_folds(labelled(spark, dict(bug=50, style=23, performance=11)), "key")
    sizes = {(r.label, r.fold): r["count"] for r in folded.groupBy("label", "fold").count().collect()}
    assert [[sizes[c, f] for f in range(1, 6)] for c in ("bug", "style", "performance")] == [
        [10] * 5, [5, 5, 5, 4, 4], [2, 2, 2, 3, 2],
    ]


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_folds_are_even_complete_and_independent_of_the_partitions(spark, parts):
    rng = random.Random(1)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = {c: rng.randrange(1, 200) for c in C.CATEGORIES}
    rows = labelled(spark, sizes)
    got = folds.assign_folds(rows, "key").collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(got, key=lambda r: (C.CATEGORIES.index(r.label), hashlib.md5(f"{r.key}:{C.FOLD_SEED}".encode()).hexdigest(), r.key))
    assert [r.fold for r in order] == [i % 5 + 1 for i in range(len(order))]
    assert sorted(r.key for r in got) == list(range(sum(sizes.values())))
    for group in [None, *C.CATEGORIES]:
        counts = [sum(r.fold == f and group in (None, r.label) for r in got) for f in range(1, 6)]
        assert max(counts) - min(counts) <= 1
    same = folds.assign_folds(rows.repartition(7), "key").collect()
    assert {(r.key, r.fold) for r in got} == {(r.key, r.fold) for r in same}
    other = folds.assign_folds(rows, "key", seed=1).collect()
    assert {(r.key, r.fold) for r in got} != {(r.key, r.fold) for r in other}


def test_one_hot_class_is_ranked_in_many_tasks(spark):
    label = F.when(F.col("id") < 15000, "ok").otherwise("bug")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(20000).select(F.col("id").alias("key"), label.alias("label"), F.repeat(F.lit("text"), 50).alias("code"))
    folded = folds.assign_folds(rows, "key").cache()
    parts = folds.ranks(rows, "key").groupBy(F.floor(F.col("place") / 5000)).count().collect()
    assert [r["count"] for r in parts] == [5000] * 4
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # The text takes no part in a sort.
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window [" in plan
    sizes = [r["count"] for r in folded.groupBy("label", "fold").count().collect()]
    assert sorted(sizes) == [1000] * 5 + [3000] * 5


def test_split_fold(spark):
    rows = folds.assign_folds(labelled(spark, dict(bug=20, ok=7)), "key")
    seen = []
    for f in range(1, 6):
        training, validation = folds.split_fold(rows, f)
        t, v = {r.key for r in training.collect()}, {r.key for r in validation.collect()}
        assert not t & v and len(t | v) == 27
        seen += v
    assert sorted(seen) == list(range(27))


def predictions(spark, pairs, fold=1):
    rows = [(str(i), fold, a, b) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "key string, fold int, label string, prediction string")


def test_small_report(spark):
    rows = predictions(spark, [("bug", "bug"), ("bug", "style"), ("style", "style")])
    got = {r.name: r for r in metrics.classification_report(rows).collect()}
    assert [r for r in got] == C.CATEGORIES + ["accuracy", "macro avg", "weighted avg"]
    values = lambda n: tuple(round(got[n][c], 3) for c in ("precision", "recall", "f1", "support"))
    assert values("bug") == (1, 0.5, 0.667, 2)
    assert values("style") == (0.5, 1, 0.667, 1)
    assert values("ok") == (0, 0, 0, 0)
    assert values("accuracy") == (0.667, 0.667, 0.667, 3)
    assert round(metrics.macro_f1(rows).first().macro_f1, 3) == 0.667
    assert round(metrics.accuracy(rows).first().accuracy, 3) == 0.667


def brute_force(pairs):
    classes = sorted({c for p in pairs for c in p})
    f1 = []
    for c in classes:
        tp = sum(a == b == c for a, b in pairs)
        p = tp / max(1, sum(b == c for _, b in pairs))
        r = tp / max(1, sum(a == c for a, _ in pairs))
        f1.append(2 * p * r / (p + r) if p + r else 0.0)
    return sum(a == b for a, b in pairs) / len(pairs), sum(f1) / len(f1)


def test_fold_metrics_against_brute_force(spark):
    rng = random.Random(2)
    by_fold = {f: [(rng.choice(C.CATEGORIES[:f]), rng.choice(C.CATEGORIES)) for _ in range(30)] for f in range(1, 6)}
    rows = metrics.pool(*[predictions(spark, pairs, f) for f, pairs in by_fold.items()])
    got = {r.fold: r for r in metrics.fold_metrics(rows).collect()}
    macro = {r.fold: r.macro_f1 for r in metrics.macro_f1(rows, "fold").collect()}
    for fold, pairs in by_fold.items():
        accuracy, f1 = brute_force(pairs)
        assert math.isclose(got[fold].accuracy, accuracy)
        assert math.isclose(got[fold].macro_f1, f1) and math.isclose(macro[fold], f1)
    summary = metrics.summarise_folds(metrics.fold_metrics(rows)).first()
    scores = [brute_force(p)[0] for p in by_fold.values()]
    mean = sum(scores) / 5
    assert math.isclose(summary.mean_accuracy, mean)
    assert math.isclose(summary.std_accuracy, math.sqrt(sum((s - mean) ** 2 for s in scores) / 5))


def test_counts_over_the_domain(spark):
    rows = spark.createDataFrame([("bug",), ("ok",), ("ok",), ("other",), (None,)], "category string")
    assert [tuple(r) for r in D.category_counts(rows).collect()] == [
        ("bug", 0, 1), ("style", 1, 0), ("performance", 2, 0), ("security", 3, 0), ("ok", 4, 2)]
    filled = D.zero_fill(rows.groupBy("category").agg(F.count("*").alias("n")))
    assert sorted(tuple(r) for r in filled.collect()) == sorted(tuple(r) for r in D.category_counts(rows).collect())
    assert [r.category for r in D.shown_counts(D.category_counts(rows)).collect()] == ["bug"]
    assert [tuple(r) for r in D.distribution(rows, "category").collect()] == [("ok", 2), ("bug", 1), ("other", 1)]
    assert [r.category for r in D.in_summary_order(D.category_counts(rows)).collect()] == C.SUMMARY_ORDER
    assert [r.category for r in D.in_index_order(D.category_counts(rows)).collect()] == C.CATEGORIES
    empty = rows.where("1 = 0")
    assert [r.n for r in D.category_counts(empty).collect()] == [0] * 5


def test_equal_rows_are_dealt_out_evenly(spark, tmp_path):
    path = str(tmp_path / "copies")
    copies = spark.range(7000).select(F.when(F.col("id") < 5000, "ok").otherwise("bug").alias("label"))
    copies.repartition(3).write.parquet(path)
    rows = with_row_id(spark.read.parquet(path))
    assert rows.select("row_id").distinct().count() == 7000
    sizes = folds.assign_folds(rows, "row_id").groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [400] * 5 + [1000] * 5
    buckets = rows.select(F.substring(F.md5(F.concat("row_id", F.lit(":42"))), 1, 1).alias("b")).groupBy("b").count().collect()
    assert len(buckets) == 16 and max(r["count"] for r in buckets) < 600


def test_labels_outside_the_domain_make_one_class(spark):
    rows = spark.range(100).select(F.col("id").alias("key"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"))
    got = folds.assign_folds(rows, "key")
    assert [r["count"] for r in got.groupBy("fold").count().collect()] == [20] * 5
