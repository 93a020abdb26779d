import math
from threading import Lock

import numpy as np
import pytest
from pyspark.ml.feature import IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from acceptance import modelling
from patchlight import constants as C
from patchlight.operators import classifier as M
from patchlight.operators import metrics
from patchlight.plans.review import by_model, find
from patchlight.sources.models import load_model, save_model

WORDS = {"bug": "null error", "style": "naming comment", "performance": "slow cache", "security": "token password", "ok": "plain text"}
SIZES = {"bug": 30, "style": 15, "performance": 12, "security": 10, "ok": 40}


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (f"{c}-{i}", f"{WORDS[c]} x{i % 7} = {i % 5}", c) for c, n in SIZES.items() for i in range(n)
    ]
    return spark.createDataFrame(data, "key string, code string, label string").cache()


@pytest.fixture(scope="module")
def model(rows):
    return M.train(rows, size=256, max_iter=15)


def test_token_counts(spark):
    texts = ["", "a_b = f(x) + 'é1'", "w " * 600]
    counted = M.token_counts(spark.createDataFrame([(t,) for t in texts], "code string"), "code", 64)
    assert counted.columns == ["code", "counts"]
    sums = [sum(r.v) for r in counted.select(vector_to_array("counts").alias("v")).collect()]
    assert sums == [0, 10, 512]


def test_the_classifier_learns_and_its_confidence_is_the_top_probability(rows, model):
    got = M.classify(rows, model).collect()
    assert sum(r.label == r.category for r in got) == len(got)
    assert all(0.2 <= r.confidence <= 1 for r in got)


def test_save_and_load(spark, rows, model, tmp_path):
    path = str(tmp_path / "model")
    save_model(model, path)
    again = M.classify(rows, load_model(spark, path)).orderBy("key").collect()
    assert again == M.classify(rows, model).orderBy("key").collect()
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))


def test_cross_validation(rows):
    predictions, last = M.cross_validate(rows, "key", size=256, parallelism=2, max_iter=15)
    got = predictions.collect()
    assert sorted(r.key for r in got) == sorted(r.key for r in rows.collect())
    scores = metrics.fold_metrics(predictions).collect()
    assert [r.fold for r in sorted(scores)] == [1, 2, 3, 4, 5]
    assert all(r.accuracy > 0.9 and r.macro_f1 > 0.9 for r in scores)
    assert M.classify(rows, last).columns == ["key", "code", "label", "category", "confidence"]


@pytest.mark.parametrize("source, query", [("T.code_rows", "_cross_validated"), ("_marked_rows", "marked_classes_cross_validated")])
def test_no_more_than_three_fits_hold_their_rows_at_once(spark, rows, monkeypatch, source, query):
    """All five folds are fitted, three and two at a time; four at a time found no room for their rows at size."""
    running, most, fits, lock, fit = set(), [], [], Lock(), M.fit

    def counted(train, **options):
        with lock:
            fits.append(len(fits))
            running.add(own := fits[-1])
            most.append(len(running))
        try:
            return fit(train, **options, max_iter=2)
        finally:
            with lock:
                running.remove(own)

    monkeypatch.setattr(M, "fit", counted)
    monkeypatch.setattr(f"acceptance.modelling.{source}", lambda *_: rows)
    made = getattr(modelling, query)(spark, "")
    predictions = made[0] if isinstance(made, tuple) else made
    assert predictions.count() == rows.count() and len(fits) == C.N_FOLDS and 1 < max(most) <= 3


def test_the_last_fold_alone_is_the_last_fold_of_all(rows, monkeypatch):
    """One fit gives the model and the predictions that the fold has among all five."""
    everything, last = M.cross_validate(rows, "key", size=256, max_iter=15)
    fits, fit = [], M.fit
    monkeypatch.setattr(M, "fit", lambda *args, **options: fits.append(1) or fit(*args, **options))
    alone, model = M.cross_validate(rows, "key", size=256, max_iter=15, folds=[C.N_FOLDS])
    assert len(fits) == 1
    of_fold = everything.where(F.col("fold") == C.N_FOLDS).orderBy("key").collect()
    assert of_fold and alone.orderBy("key").collect() == of_fold
    assert np.allclose(model.stages[-1].coefficientMatrix.toArray(), last.stages[-1].coefficientMatrix.toArray(), atol=1e-6)
    assert np.allclose(model.stages[-2].getScalingVec().toArray(), last.stages[-2].getScalingVec().toArray())
    for wrong in ([], [0], [C.N_FOLDS + 1]):
        with pytest.raises(ValueError):
            M.cross_validate(rows, "key", folds=wrong)


def test_frequencies_are_fitted_on_the_training_part_only(rows):
    prepared = M.prepare(rows, "code", "label", 256, "key")
    part = prepared.where("label <> 'bug' OR key = 'bug-0'")
    fitted = M.fit(part, max_iter=2)
    spark_idf = IDF(inputCol="counts", outputCol="x").fit(part)
    assert spark_idf.numDocs == part.count() < prepared.count()
    assert np.allclose(fitted.stages[1].getScalingVec().toArray(), spark_idf.idf.toArray())


def test_frequencies_of_the_folds_by_subtraction(rows):
    """One scan gives what five separate fits give."""
    prepared = M.assign_folds(M.prepare(rows, "code", "label", 256, "key"), "key")
    stages = M.fold_idf_stages(prepared)
    assert sorted(stages) == [1, 2, 3, 4, 5]
    for fold, stage in stages.items():
        training, _ = M.split_fold(prepared, fold)
        separate = IDF(inputCol="counts", outputCol="x").fit(training)
        assert np.allclose(stage.getScalingVec().toArray(), separate.idf.toArray(), atol=1e-12)


def test_training_objective_falls(rows):
    fitted = M.fit(M.prepare(rows, "code", "label", 256), max_iter=10)
    losses = [r.objective for r in M.training_objective(fitted).orderBy("step").collect()]
    assert losses[-1] < losses[0] and math.isclose(losses[0], math.log(5), rel_tol=0.1)


def test_embeddings_have_unit_length(rows):
    idf = M.fit_idf(rows, "code")
    got = M.embed(rows, "code", idf).select("key", "embedding").collect()
    assert all(len(r.embedding) == C.EMBEDDING_SIZE for r in got)
    assert all(math.isclose(sum(x * x for x in r.embedding), 1, rel_tol=1e-4) for r in got)


def test_model_review_with_fallback(spark, rows):
    model = M.train(rows.withColumnRenamed("code", "chunk"), "chunk", size=256, max_iter=15)
    files = spark.createDataFrame(
        [("r", "a.py", "Python", "null error\nx1 = 2", 2, 0), ("r", "b.py", "Python", None, 0, 0)],
        "review_key string, filename string, language string, patch string, additions int, deletions int",
    )
    got = find(files, by_model(model)).collect()
    assert [(r.filename, r.category, r.confidence > 0.5) for r in got] == [("a.py", "bug", True)]
    assert [(r.category, r.confidence) for r in find(files, by_model(model, 1.1)).collect()] == [("bug", 0.0)]


def test_external_model(spark):
    def make_predict():
        import numpy as np

        def predict(texts):
            return np.array([[0.1, 0.2, 0.3, 0.15, 0.25] if "slow" in t else [0.9, 0.1, 0, 0, 0] for t in texts])

        return predict

    rows = spark.createDataFrame([("slow",), ("x",)], "chunk string")
    got = M.classify_external(rows, "chunk", make_predict).collect()
    assert [tuple(r) for r in got] == [("slow", "performance", 0.3), ("x", "bug", 0.9)]
