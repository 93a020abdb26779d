"""Training, scoring, embedding and cross-validation."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from acceptance import tables as T
from acceptance.registry import check
from patchlight import constants as C
from patchlight.functions.labels import top_category, top_confidence
from patchlight.operators import classifier as M
from patchlight.operators.folds import attach_weights, class_weights
from patchlight.operators import metrics
from patchlight.plans.review import by_model, find, review
from patchlight.session import work_dir
from patchlight.sources.models import load_model, save_model
from patchlight.sources.tables import materialise

# How much of the gradient at zero may be left after the fit.
OPTIMUM = 0.015

# Folds fitted at the same time: three and then two. A fit keeps its training part in storage memory, and no fold is left to run alone.
FITS_AT_ONCE = 3

TOKENS = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


@check(
    "M1",
    f"""SELECT doc_id AS key,
               CAST(least(len(regexp_extract_all(lower(left(text, 2000)), '{TOKENS}')), {C.MAX_TOKENS}) AS BIGINT) AS n_tokens
        FROM documents""",
)
def bounded_tokens(spark, sf):
    """The hashed counts of a text add up to its tokens, 512 at most."""
    counted = M.token_counts(T.code_rows(spark, sf), "code", M.SIZE)
    total = F.aggregate(vector_to_array("counts"), F.lit(0.0), lambda a, x: a + x)
    return counted.select("key", total.cast("bigint").alias("n_tokens"))


@check("M1")
def token_features(spark, sf):
    return M.token_counts(T.code_rows(spark, sf), "code", M.SIZE).select(
        "key", vector_to_array("counts").alias("counts")
    )


def _model(rows, text="code"):
    return M.train(rows.withColumnRenamed("code", text), text)


@check("M2 M3")
def classified_texts(spark, sf):
    rows = T.code_rows(spark, sf)
    return M.classify(rows, _model(rows)).drop("code")


@check("S9")
def saved_model_scores(spark, sf):
    path = work_dir(spark, "model")
    rows = T.code_rows(spark, sf)
    save_model(_model(rows), path)
    return M.classify(rows, load_model(spark, path)).drop("code")


@check("S9", "SELECT doc_id AS key, TRUE AS same FROM documents")
def saved_model_agrees(spark, sf):
    """A model read back gives each text the category and confidence it had before."""
    path = work_dir(spark, "model")
    rows = T.code_rows(spark, sf)
    model = _model(rows)
    save_model(model, path)
    before = M.classify(rows, model).select("key", F.struct("category", "confidence").alias("before"))
    after = M.classify(rows, load_model(spark, path)).select(
        "key", F.struct("category", "confidence").alias("after")
    )
    return before.join(after, "key").select("key", (F.col("before") == F.col("after")).alias("same"))


@check(
    "M3",
    """SELECT doc_id, ['bug','style','performance','security','ok'][length(text) % 5 + 1] AS category,
              CAST(0.6 AS DOUBLE) AS confidence FROM documents""",
)
def external_model_scores(spark, sf):
    """A stand-in for a model of another library: the class is the length of the text modulo 5."""

    def load():
        import numpy as np

        def predict(texts):
            lengths = np.array([len(t) for t in texts])
            return np.where(np.arange(5) == (lengths % 5)[:, None], 0.6, 0.1)

        return predict

    rows = T.documents(spark, sf).select("doc_id", "text")
    return M.classify_external(rows, "text", load).select("doc_id", "category", "confidence")


def _objective(spark, sf):
    return M.training_objective(M.fit(M.prepare(T.code_rows(spark, sf), "code", "label", M.SIZE)))


@check("A16")
def training_loss(spark, sf):
    return _objective(spark, sf)


@check("A16", "SELECT round(ln(5), 6) AS first, TRUE AS never_rises")
def training_objective_falls(spark, sf):
    """With balanced weights the first objective is ln 5, and no step raises it."""
    steps = _objective(spark, sf).agg(F.sort_array(F.collect_list(F.struct("step", "objective"))).alias("s"))
    rises = F.exists(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s.objective", i) > F.get("s.objective", i - 1))
    return steps.select(F.round(F.get("s.objective", F.lit(0)), 6).alias("first"), (~rises).alias("never_rises"))


@check(
    "M2",
    "SELECT c AS category, CAST(0.2 AS DOUBLE) AS mean_probability FROM (SELECT unnest(['bug','style','performance','security','ok']) AS c)",
)
def class_mean_probability(spark, sf):
    """Where the fit has converged, the weighted mean probability of each class is its weighted share."""
    rows = T.code_rows(spark, sf)
    scored = _model(rows).transform(attach_weights(rows, class_weights(rows)))
    p = vector_to_array("probability")
    means = [(F.sum(F.col("weight") * F.get(p, F.lit(i))) / F.sum("weight")).alias(c) for i, c in enumerate(C.CATEGORIES)]
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.round(c, 1).alias("mean_probability")) for c in C.CATEGORIES])
    return scored.agg(*means).select(F.inline(pairs))


@check(
    "M4",
    f"""WITH {T.with_probabilities()},
        scored AS (SELECT vec_id, list_max([p1, p2, p3, p4, p5]) AS p,
                          ['bug','style','performance','security','ok'][list_position([p1, p2, p3, p4, p5], list_max([p1, p2, p3, p4, p5]))] AS c
                   FROM probabilities)
        SELECT doc_id, CASE WHEN coalesce(p, 0) < 0.235 THEN {T.sql_heuristic('text', C.HEURISTIC_KEYWORDS)} ELSE c END AS category,
               CASE WHEN coalesce(p, 0) < 0.235 THEN 0 ELSE round(p, 6) END AS confidence
        FROM documents LEFT JOIN scored ON doc_id = vec_id""",
)
def low_confidence_fallback(spark, sf):
    scores = T.probabilities(spark, sf).select(
        F.col("vec_id").alias("doc_id"),
        top_category(F.col("p")).alias("category"),
        top_confidence(F.col("p")).alias("confidence"),
    )
    scored = T.documents(spark, sf).select("doc_id", F.col("text").alias("chunk")).join(scores, "doc_id", "left")
    scored = scored.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return M.apply_fallback(scored, 0.235).select(
        "doc_id", "category", F.round("confidence", 6).alias("confidence")
    )


def _embedded(spark, sf):
    chunks = T.chunks(spark, sf)
    return M.embed(chunks, "chunk", M.fit_idf(chunks, "chunk"))


@check("M5")
def chunk_embeddings(spark, sf):
    return _embedded(spark, sf).select("filename", "chunk_index", "embedding")


@check(
    "M5",
    f"""WITH {T.with_chunks()}
        SELECT filename, chunk_index, CAST({C.EMBEDDING_SIZE} AS INTEGER) AS dimensions,
               CASE WHEN trim(chunk, ' ' || chr(9) || chr(10)) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM chunks""",
)
def embedding_norms(spark, sf):
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return _embedded(spark, sf).select(
        "filename", "chunk_index", F.size("embedding").alias("dimensions"),
        F.round(F.sqrt(square), 3).alias("norm"),
    )


def _cross_validated(spark, sf):
    return M.cross_validate(T.code_rows(spark, sf), "key", parallelism=FITS_AT_ONCE)


@check("M6 A13")
def cross_validation_report(spark, sf):
    return metrics.classification_report(_cross_validated(spark, sf)[0])


@check("M6 A11 A12")
def cross_validation_folds(spark, sf):
    return metrics.fold_metrics(_cross_validated(spark, sf)[0])


@check(
    "M6 O6",
    f"""WITH {T.with_training()}, coded AS (SELECT CAST(pr_number AS VARCHAR) AS key, label FROM training)
        SELECT key, label, {T.sql_fold('key')} AS fold FROM coded""",
)
def cross_validated_rows(spark, sf):
    """Each row is predicted once, in its own fold."""
    return _cross_validated(spark, sf)[0].select("key", "label", "fold")


@check(
    "M6 A13",
    f"WITH {T.with_training()} SELECT label, count(*) AS support FROM training GROUP BY label",
)
def cross_validation_supports(spark, sf):
    """The supports of the report are the sizes of the classes."""
    report = metrics.classification_report(_cross_validated(spark, sf)[0])
    known = report.where(F.col("name").isin(*C.CATEGORIES) & (F.col("support") > 0))
    return known.select(F.col("name").alias("label"), F.col("support").cast("bigint").alias("support"))


@check("M6 A11", f"SELECT CAST(i AS INTEGER) AS fold, TRUE AS same FROM (SELECT unnest(range(1, {C.N_FOLDS + 1})) AS i)")
def cross_validation_accuracies(spark, sf):
    """The accuracy of each fold is the share of its written predictions that are right."""
    predicted = materialise(_cross_validated(spark, sf)[0], "predictions")
    plain = predicted.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("plain"))
    reported = metrics.fold_metrics(predicted).select("fold", "accuracy")
    return reported.join(plain, "fold").select("fold", (F.abs(F.col("accuracy") - F.col("plain")) < 1e-9).alias("same"))


@check("M7")
def final_model_scores(spark, sf):
    rows = T.code_rows(spark, sf)
    _, model = M.cross_validate(rows, "key", folds=[C.N_FOLDS])
    return M.classify(rows, model).drop("code")


@check(
    "M7",
    f"""WITH {T.with_training()}, coded AS (SELECT CAST(pr_number AS VARCHAR) AS key, label FROM training),
        folded AS (SELECT key, {T.sql_fold('key')} AS fold FROM coded)
        SELECT key, TRUE AS same FROM folded WHERE fold = {C.N_FOLDS}""",
)
def final_model_agrees(spark, sf):
    """The model that comes back gives the rows of the last fold the labels pooled for them."""
    rows = T.code_rows(spark, sf)
    predicted, model = M.cross_validate(rows, "key", folds=[C.N_FOLDS])
    pooled = predicted.where(F.col("fold") == C.N_FOLDS).select("key", "prediction")
    scored = M.classify(rows, model).select(F.col("key").cast("string").alias("key"), "category")
    return pooled.join(scored, "key").select("key", (F.col("prediction") == F.col("category")).alias("same"))


@check("M3 M8")
def model_review(spark, sf):
    return _reviewed(spark, sf).select("filename", "chunk_index", "category", "confidence", "feedback")


def _reviewed(spark, sf):
    model = _model(T.code_rows(spark, sf), "chunk")
    return review(T.files(spark, sf), T.comments(spark, sf), by_model(model), 5)


@check(
    "M8",
    f"""WITH {T.with_commented()} SELECT review_key, filename, language, chunk_index, chunk, feedback,
               TRUE AS known_category, TRUE AS fair_confidence FROM commented""",
)
def model_review_columns(spark, sf):
    """A model changes category and confidence alone, to one of five and to 0.2 or more."""
    return _reviewed(spark, sf).select(
        "review_key", "filename", "language", "chunk_index", "chunk", "feedback",
        F.col("category").isin(*C.CATEGORIES).alias("known_category"),
        F.col("confidence").between(0.2, 1.0).alias("fair_confidence"),
    )


# --- Models that have to have learned something ------------------------------

# Two classes differ by how often words occur, not by which: a single step cannot tell them apart.
def _marks(name, times):
    return " ".join(f"{name}{j}" for j in range(110)) + " " if times == 1 else _marks(name, 1) * times


MARKS = [_marks("one", 1), _marks("one", 4), _marks("two", 2), _marks("three", 2), _marks("four", 2)]
SQL_MARKED = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(C.CATEGORIES)) + " END"


def _marked(docs, text):
    """Texts behind words that tell their class, the number of the document modulo 5."""
    kind = F.col("doc_id") % 5
    mark = F.get(F.array(*map(F.lit, MARKS)), kind.cast("int"))
    label = F.get(F.array(*map(F.lit, C.CATEGORIES)), kind.cast("int"))
    return docs.withColumn("label", label).withColumn(text, F.concat(mark, text))


def _marked_rows(spark, sf):
    docs = T.documents(spark, sf).select("doc_id", F.substring("text", 1, C.MAX_PATCH_CHARS).alias("code"))
    return materialise(_marked(docs, "code").withColumnRenamed("doc_id", "key"), "marked")


@check("M2 M3", f"SELECT doc_id AS key, {SQL_MARKED} AS category FROM documents")
def marked_classes_learned(spark, sf):
    """Every text gets the class that its words tell; no model that does not read them, and none of one step, does that."""
    rows = _marked_rows(spark, sf)
    return M.classify(rows, M.train(rows)).select("key", "category")


@check(
    "M8 M3",
    f"""WITH {T.with_files()} SELECT review_key, filename, {SQL_MARKED} AS category, TRUE AS sure FROM files WHERE patch <> ''""",
)
def marked_files_reviewed(spark, sf):
    """A model trained on marked texts reviews marked files, one chunk each."""
    model = M.train(_marked_rows(spark, sf).withColumnRenamed("code", "chunk"), "chunk")
    files = _marked(T.files(spark, sf).where("patch <> ''"), "patch").drop("label")
    found = find(files, by_model(model), 1 << 20)
    return found.select("review_key", "filename", "category", (F.col("confidence") > 0.3).alias("sure"))


@check(
    "M6",
    f"""WITH coded AS (SELECT CAST(doc_id AS VARCHAR) AS key, {SQL_MARKED} AS label FROM documents)
        SELECT key, {T.sql_fold('key')} AS fold, label AS prediction FROM coded""",
)
def marked_classes_cross_validated(spark, sf):
    """Each fold's model, which has not seen the row, predicts the class that its words tell."""
    return M.cross_validate(_marked_rows(spark, sf), "key", parallelism=FITS_AT_ONCE)[0].select("key", "fold", "prediction")


@check("M7", f"SELECT doc_id AS key, {SQL_MARKED} AS category FROM documents")
def marked_classes_by_the_last_fold(spark, sf):
    rows = _marked_rows(spark, sf)
    _, model = M.cross_validate(rows, "key", folds=[C.N_FOLDS])
    return M.classify(rows, model).select("key", "category")


def gradient(rows, fitted, reg_param):
    """Per class, the length of the objective's gradient in the coefficients, as a share of its length where all are zero.

    At the optimum, the weighted excess of probability over occurrence of a class along a column equals the penalty's pull, which Spark
    takes on standardised columns.
    """
    scored = fitted.transform(rows).withColumn("_p", vector_to_array("probability"))
    x, w = F.col("features"), F.col("weight")
    sums = [Summarizer.metrics("mean", "variance").summary(x, w).alias("all"), F.sum(w).alias("w")]
    for k, c in enumerate(C.CATEGORIES):
        p, y = w * F.get("_p", F.lit(k)), w * (F.col("label") == c).cast("double")
        sums += [Summarizer.metrics("mean").summary(x, p).alias(f"p{k}"), F.sum(p).alias(f"wp{k}")]
        sums += [Summarizer.metrics("mean").summary(x, y).alias(f"y{k}"), F.sum(y).alias(f"wy{k}")]
    row = scored.agg(*sums).first()
    out = {}
    for k, c in enumerate(C.CATEGORIES):
        expected = row[f"p{k}"]["mean"].toArray() * row[f"wp{k}"]
        actual = row[f"y{k}"]["mean"].toArray() * row[f"wy{k}"]
        pull = reg_param * fitted.stages[-1].coefficientMatrix.toArray()[k] * row["all"]["variance"].toArray()
        start = row["all"]["mean"].toArray() * row["w"] / len(C.CATEGORIES)
        out[c] = float(np.linalg.norm((expected - actual) / row["w"] + pull) / np.linalg.norm((start - actual) / row["w"]))
    return out


@check("M2", "SELECT c AS category, TRUE AS at_optimum FROM (SELECT unnest(['bug','style','performance','security','ok']) AS c)")
def coefficients_at_optimum(spark, sf):
    """The first-order conditions of the fit, class by class, over all columns."""
    rows = M.prepare(T.code_rows(spark, sf), "code", "label", M.SIZE)
    shares = gradient(rows, M.fit(rows, reg_param=0.01), 0.01)
    found = spark.createDataFrame(list(shares.items()), "category string, share double")
    return found.select("category", (F.col("share") < OPTIMUM).alias("at_optimum"))


@check(
    "A16",
    f"""WITH {T.with_training()}, counted AS (SELECT lang, t.label, count(*) AS n FROM training t JOIN documents d ON d.doc_id = t.pr_number GROUP BY ALL),
        weighed AS (SELECT *, n * (sum(n) OVER ()) / (5 * sum(n) OVER (PARTITION BY label)) AS w FROM counted),
        shared AS (SELECT w, w / sum(w) OVER (PARTITION BY lang) AS p FROM weighed)
        SELECT round(-sum(w * ln(p)) / sum(w), 2) AS loss FROM shared""",
)
def loss_of_one_word_texts(spark, sf):
    """Texts of one word, the language of the document: without a penalty, the loss goes to the entropy of the labels given the language."""
    langs = T.documents(spark, sf).select(F.col("doc_id").alias("pr_number"), F.col("lang").alias("code"))
    rows = T.training(spark, sf).select("pr_number", "label").join(langs, "pr_number")
    fitted = M.fit(M.prepare(materialise(rows, "words"), "code", "label", M.SIZE), max_iter=200, reg_param=0.0)
    return M.training_objective(fitted).agg(F.round(F.max_by("objective", "step"), 2).alias("loss"))


@check(
    "A16",
    f"""WITH {T.with_training()}, {T.with_probabilities().lstrip()},
        sizes AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM training GROUP BY label),
        scored AS (SELECT repo, total / (5 * n) AS weight, [p1, p2, p3, p4, p5][list_position(['bug','style','performance','security','ok'], t.label)] AS p
                   FROM training t JOIN probabilities ON vec_id = pr_number JOIN sizes s ON s.label = t.label)
        SELECT repo, round(sum(-ln(p) * weight) / sum(weight), 6) AS loss FROM scored GROUP BY repo""",
)
def weighted_cross_entropy(spark, sf):
    """The loss of recorded probabilities, per repository."""
    rows = T.training(spark, sf).select("repo", "pr_number", "label")
    weighted = attach_weights(rows, class_weights(materialise(rows.select("label"), "labels")))
    scored = weighted.join(T.probabilities(spark, sf).withColumnRenamed("vec_id", "pr_number"), "pr_number")
    return metrics.cross_entropy(scored, "repo").withColumn("loss", F.round("loss", 6))
