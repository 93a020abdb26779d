"""Text classifier over five categories on Spark ML, and a seam for an external model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF,
    ElementwiseProduct,
    IDFModel,
    HashingTF,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StringIndexerModel,
)
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight import constants as C
from patchlight.functions.labels import category_of, top_category, top_confidence, with_fallback
from patchlight.operators.columns import with_columns_once
from patchlight.operators.folds import assign_folds, attach_weights, class_weights, split_fold
from patchlight.operators.metrics import pool
from patchlight.sources.tables import materialise

# A token is a run of word characters or a single other sign.
# Columns that tokens are hashed to.
SIZE = 4096

TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def token_stages(text: str, size: int) -> list:
    """Text to the term counts of its first 512 tokens, hashed to ``size`` columns."""
    return [
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=TOKEN, gaps=False),
        SQLTransformer(
            statement=f"SELECT *, slice(tokens, 1, {C.MAX_TOKENS}) AS bounded FROM __THIS__"
        ),
        HashingTF(inputCol="bounded", outputCol="counts", numFeatures=size),
    ]


def label_stage() -> StringIndexerModel:
    """Category to class index; the order of the domain is fixed, so nothing is fitted."""
    return StringIndexerModel.from_labels(
        C.CATEGORIES, inputCol="label", outputCol="target", handleInvalid="error"
    )


def token_counts(rows: DataFrame, text: str, size: int) -> DataFrame:
    """Add ``counts``, the hashed term counts; no state is fitted."""
    stages = PipelineModel(stages=token_stages(text, size))
    return stages.transform(rows).drop("tokens", "bounded")


def term_frequencies(rows: DataFrame, *keys: str) -> DataFrame:
    """``n`` rows and ``holding``, a vector with the number of rows that hold each column, per ``keys``."""
    held = Summarizer.metrics("count", "numNonZeros").summary(F.col("counts"))
    return rows.groupBy(*keys).agg(held.alias("s")).select(*keys, F.col("s.count").alias("n"), F.col("s.numNonZeros").alias("holding"))


def idf_stage(n: int, holding: np.ndarray) -> ElementwiseProduct:
    """Weights a column by ln((n + 1) / (rows that hold it + 1))."""
    weights = np.log((n + 1.0) / (holding + 1.0))
    return ElementwiseProduct(inputCol="counts", outputCol="features", scalingVec=Vectors.dense(weights))


def fold_idf_stages(prepared: DataFrame) -> dict[int, ElementwiseProduct]:
    """The IDF stage of the training part of each fold: the sums of all rows less those of the fold, from one scan."""
    sums = {r.fold: (r.n, r.holding.toArray()) for r in term_frequencies(prepared, "fold").collect()}
    n, holding = (sum(s[i] for s in sums.values()) for i in (0, 1))
    return {fold: idf_stage(n - own, holding - held) for fold, (own, held) in sums.items()}


def fit(train: DataFrame, max_iter: int = 50, reg_param: float = 0.01, idf: ElementwiseProduct | None = None) -> PipelineModel:
    """Fit IDF and the weighted five-way logistic regression on ``counts, label, weight``.

    Only sums of fixed size (features, features * classes) travel to the driver. ``idf`` is given where the
    frequencies are known already.
    """
    if idf is None:
        total = term_frequencies(train).first()
        idf = idf_stage(total.n, total.holding.toArray())
    learner = LogisticRegression(
        featuresCol="features",
        labelCol="target",
        weightCol="weight",
        family="multinomial",
        maxIter=max_iter,
        regParam=reg_param,
    )
    return Pipeline(stages=[label_stage(), idf, learner]).fit(train)


def scoring_model(fitted: PipelineModel, text: str, size: int) -> PipelineModel:
    """The model that takes plain text: token stages, fitted IDF, fitted classifier."""
    return PipelineModel(stages=token_stages(text, size) + fitted.stages[1:])


def prepare(rows: DataFrame, text: str, label: str, size: int, *keys: str) -> DataFrame:
    """Weighted term counts of the labelled texts as a written table.

    Fitting reads its input many times; the text work is done once, and a lost executor
    reads the files again instead of repeating it.
    """
    named = rows.select(*keys, text, F.col(label).alias("label"))
    weighted = attach_weights(named, class_weights(named))
    return materialise(token_counts(weighted, text, size).drop(text), "features")


def train(
    rows: DataFrame, text: str = "code", label: str = "label", size: int = SIZE, **fit_options
) -> PipelineModel:
    """Class-weighted classifier on all rows of ``text, label``."""
    return scoring_model(fit(prepare(rows, text, label, size), **fit_options), text, size)


def classify(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``category`` and ``confidence``; the text column is the one the model was made for."""
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    return _with_top(scored).select(*rows.columns, "category", "confidence")


def _with_top(scored: DataFrame) -> DataFrame:
    """Category and confidence of the probabilities in ``_p``; scoring runs once per row."""
    p = F.col("_p")
    return with_columns_once(
        scored, {"category": top_category(p), "confidence": top_confidence(p)}
    ).drop("_p")


def classify_external(
    rows: DataFrame, text: str, make_predict_fn: Callable, batch_size: int = 64
) -> DataFrame:
    """Like ``classify`` with a model of another library.

    ``make_predict_fn`` loads the model once per Python worker and returns a function
    from a batch of texts to five probabilities each.
    """
    predict = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    return _with_top(rows.withColumn("_p", predict(F.col(text))))


def apply_fallback(scored: DataFrame, threshold: float, text: str = "chunk") -> DataFrame:
    """Keyword heuristic in place of the results below the threshold."""
    category, confidence = with_fallback(
        F.col("category"), F.col("confidence"), F.col(text), threshold
    )
    return with_columns_once(scored, {"category": category, "confidence": confidence})


def fit_idf(rows: DataFrame, text: str, size: int = C.EMBEDDING_SIZE) -> IDFModel:
    """Document frequencies of the hashed terms."""
    return IDF(inputCol="counts", outputCol="weighted").fit(token_counts(rows, text, size))


def embed(rows: DataFrame, text: str, idf: IDFModel) -> DataFrame:
    """Add ``embedding``: the unit-length TF-IDF vector of the text as an array."""
    weighted = idf.transform(token_counts(rows, text, len(idf.idf)))
    unit = Normalizer(inputCol="weighted", outputCol="unit", p=2.0).transform(weighted)
    return unit.select(*rows.columns, vector_to_array("unit", "float32").alias("embedding"))


def training_objective(fitted: PipelineModel) -> DataFrame:
    """``step, objective``: mean weighted loss plus penalty, before the first and after each iteration."""
    learner = fitted.stages[-1]
    history = learner.summary.objectiveHistory
    rows = [(step, float(value)) for step, value in enumerate(history)]
    return learner.summary.predictions.sparkSession.createDataFrame(rows, "step int, objective double")


def cross_validate(
    rows: DataFrame,
    key: str,
    text: str = "code",
    label: str = "label",
    k: int = C.N_FOLDS,
    seed: int = C.FOLD_SEED,
    size: int = SIZE,
    parallelism: int = 1,
    folds: Sequence[int] | None = None,
    **fit_options,
) -> tuple[DataFrame, PipelineModel]:
    """Train and predict each fold; returns all predictions and the last fold's model.

    ``folds`` names the folds to train and predict, in place of all 1 .. k. No fit depends on another fold's, so who wants the
    model of one fold, or its predictions, names that fold and gets the same without the fits of the others. All rows are still
    counted, weighed and dealt out.

    The class weights are those of all rows. The term counts need no fitting and are
    shared by the folds; IDF and classifier see the training part of their fold only, the IDF by
    taking the fold's own frequencies off those of all rows (``fold_idf_stages``).
    ``parallelism`` is the number of folds fitted at the same time. Each of these fits keeps its training part in storage
    memory (about 1.9 KB a row of 161 columns) and reads it at every step; steps slow down where it finds no room there, so
    choose no more than the executors hold. ``rows`` is read twice
    (weights, texts), so pass a written table. Texts become term counts before the folds are
    dealt, and the folds are folders of a table, so a fit reads its own only.
    """
    every = range(1, k + 1)
    chosen = every if folds is None else folds
    if not chosen or not set(chosen) <= set(every):
        raise ValueError(f"folds must be some of 1 to {k}")
    named = rows.select(F.col(key).cast("string").alias("key"), text, F.col(label).alias("label"))
    counted = prepare(named, text, "label", size, "key")
    prepared = materialise(assign_folds(counted, "key", "label", k, seed), "folds", "fold")

    idf = fold_idf_stages(prepared)

    def run(fold: int) -> tuple[DataFrame, PipelineModel]:
        training, validation = split_fold(prepared, fold)
        fitted = fit(training, idf=idf.get(fold), **fit_options)
        predicted = fitted.transform(validation).select(
            "key", "fold", "label", category_of(F.col("prediction").cast("int")).alias("prediction")
        )
        return predicted, fitted

    with ThreadPoolExecutor(max_workers=parallelism) as pool_of_fits:
        results = list(pool_of_fits.map(run, chosen))
    predictions = pool(*[p for p, _ in results])
    return predictions, scoring_model(results[-1][1], text, size)
