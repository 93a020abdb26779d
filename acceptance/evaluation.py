"""Class weights, folds and metrics."""

from pyspark.sql import functions as F

from acceptance import tables as T
from acceptance.registry import check
from patchlight.operators import distributions as D
from patchlight.operators import folds, metrics
from patchlight.sources.tables import materialise, with_row_id

CLASS_TABLE = f"""
    sizes AS (SELECT label AS category, CAST({T.SQL_CLASS_INDEX} - 1 AS INTEGER) AS idx, count(*) AS n
              FROM training GROUP BY label)"""


@check(
    "A10 O2",
    f"""WITH {T.with_training()}, {CLASS_TABLE}
        SELECT category, idx, n, round((SELECT count(*) FROM training) / (5.0 * n), 6) AS weight
        FROM sizes ORDER BY idx""",
)
def class_weights(spark, sf):
    return folds.class_weights(T.training(spark, sf)).withColumn("weight", F.round("weight", 6)).orderBy("idx")


@check(
    "J1",
    f"""WITH {T.with_training()}, {CLASS_TABLE}
        SELECT repo, pr_number, label, round((SELECT count(*) FROM training) / (5.0 * n), 6) AS weight
        FROM training JOIN sizes ON label = category""",
)
def weighted_rows(spark, sf):
    rows = T.training(spark, sf).select("repo", "pr_number", "label")
    return folds.attach_weights(rows, folds.class_weights(rows)).withColumn(
        "weight", F.round("weight", 6)
    )


@check(
    "O5",
    f"WITH {T.with_training()} SELECT pr_number, label, {T.sql_fold('pr_number')} AS fold FROM training",
)
def stratified_folds(spark, sf):
    rows = materialise(T.training(spark, sf).select("pr_number", "label"), "labels")
    return folds.assign_folds(rows, "pr_number")


@check(
    "O6",
    f"""WITH {T.with_training()},
        folded AS (SELECT pr_number, label, {T.sql_fold('pr_number')} AS fold FROM training)
        SELECT pr_number, label, CASE WHEN fold = 3 THEN 'validation' ELSE 'training' END AS side FROM folded""",
)
def fold_split(spark, sf):
    folded = materialise(
        folds.assign_folds(T.training(spark, sf).select("pr_number", "label"), "pr_number"), "folds"
    )
    training, validation = folds.split_fold(folded, 3)
    return training.withColumn("side", F.lit("training")).unionByName(
        validation.withColumn("side", F.lit("validation"))
    ).drop("fold")


@check(
    "O5",
    f"""WITH {T.with_training()}, {CLASS_TABLE},
        placed AS (SELECT *, coalesce(sum(n) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                   FROM sizes)
        SELECT category AS label,
               {', '.join(f"CAST((before + n + 5 - {f}) // 5 - (before + 5 - {f}) // 5 AS BIGINT) AS fold_{f}" for f in range(1, 6))}
        FROM placed""",
)
def fold_sizes_of_equal_rows(spark, sf):
    """Rows cut down to their label, so that they differ by their place in the table only."""
    rows = with_row_id(materialise(T.training(spark, sf).select("label"), "labels"))
    folded = folds.assign_folds(rows, "row_id")
    return folded.groupBy("label").agg(
        *[F.count_if(F.col("fold") == f).alias(f"fold_{f}") for f in range(1, 6)]
    )


@check("A15", f"WITH {T.with_predictions()} SELECT label, prediction, n FROM confusion")
def confusion_counts(spark, sf):
    return metrics.confusion(T.predictions(spark, sf))


HITS = "avg(CASE WHEN label = prediction THEN 1 ELSE 0 END)"


@check("A11", f"WITH {T.with_predictions()} SELECT fold, round({HITS}, 6) AS accuracy FROM predictions GROUP BY fold")
def fold_accuracy(spark, sf):
    return metrics.accuracy(T.predictions(spark, sf), "fold").withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@check("A11", f"WITH {T.with_predictions()} SELECT round({HITS}, 6) AS accuracy FROM predictions")
def pooled_accuracy(spark, sf):
    return metrics.accuracy(T.predictions(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


FOLD_SCORES = f"""
    seen AS (SELECT fold, label AS c FROM predictions UNION SELECT fold, prediction FROM predictions),
    scored AS (
        SELECT s.fold, s.c, 2.0 * count(*) FILTER (label = s.c AND prediction = s.c)
               / (count(*) FILTER (label = s.c) + count(*) FILTER (prediction = s.c)) AS f1
        FROM seen s JOIN predictions p ON s.fold = p.fold GROUP BY s.fold, s.c),
    fold_scores AS (
        SELECT a.fold, a.accuracy, avg(f1) AS macro_f1
        FROM (SELECT fold, {HITS} AS accuracy FROM predictions GROUP BY fold) a
        JOIN scored s ON a.fold = s.fold GROUP BY a.fold, a.accuracy)"""


@check("A12", f"WITH {T.with_predictions()}, {FOLD_SCORES} SELECT fold, round(macro_f1, 6) AS macro_f1 FROM fold_scores")
def fold_macro_f1(spark, sf):
    return metrics.macro_f1(T.predictions(spark, sf), "fold").withColumn(
        "macro_f1", F.round("macro_f1", 6)
    )


@check(
    "A14",
    f"""WITH {T.with_predictions()}, {FOLD_SCORES}
        SELECT round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy,
               round(avg(macro_f1), 6) AS mean_macro_f1, round(stddev_pop(macro_f1), 6) AS std_macro_f1
        FROM fold_scores""",
)
def fold_summary(spark, sf):
    summary = metrics.summarise_folds(metrics.fold_metrics(T.predictions(spark, sf)))
    return summary.select(*[F.round(c, 6).alias(c) for c in summary.columns])


@check(
    "A13",
    f"""WITH {T.with_predictions()},
        classes AS (SELECT unnest(['bug','style','performance','security','ok']) AS c),
        counts AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp,
                          count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS predicted
                   FROM classes, predictions GROUP BY c),
        scores AS (SELECT c, support, tp,
                          CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p,
                          CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r,
                          CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * tp / (support + predicted) END AS f
                   FROM counts),
        report AS (
            SELECT c AS name, p AS precision, r AS recall, f AS f1, support FROM scores
            UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM scores
            UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM scores
            UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                             sum(f * support) / sum(support), sum(support) FROM scores)
        SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support FROM report""",
)
def classification_report(spark, sf):
    report = metrics.classification_report(T.predictions(spark, sf))
    return report.select(
        "name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@check("U2", f"WITH {T.with_predictions()} SELECT key, fold, label, prediction FROM predictions")
def pooled_predictions(spark, sf):
    rows = materialise(T.predictions(spark, sf), "predictions")
    return metrics.pool(*[folds.split_fold(rows, f)[1] for f in range(1, 6)]).select(
        "key", "fold", "label", "prediction"
    )


@check(
    "J5",
    f"""WITH {T.with_predictions()}
        SELECT c AS category, CAST(i AS INTEGER) AS idx, count(label) AS n
        FROM (SELECT unnest(['bug','style','performance','security','ok']) AS c, unnest([0, 1, 2, 3, 4]) AS i) d
        LEFT JOIN (SELECT * FROM predictions WHERE label <> prediction AND prediction <> 'style') p ON d.c = p.label
        GROUP BY c, i""",
)
def zero_filled_counts(spark, sf):
    """Wrong predictions per class, those as style left out."""
    wrong = T.predictions(spark, sf).where("label <> prediction AND prediction <> 'style'")
    return D.zero_fill(wrong.groupBy(F.col("label").alias("category")).agg(F.count("*").alias("n")))
