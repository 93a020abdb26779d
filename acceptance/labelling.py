"""Label expressions, training set, relabelling and its audit."""

from pyspark.sql import functions as F

from acceptance import tables as T
from acceptance.registry import check
from patchlight import constants as C
from patchlight.functions import labels as L
from patchlight.functions import prompts as P
from patchlight.functions.text import first_chars
from patchlight.operators import distributions as D
from patchlight.operators import filters
from patchlight.operators import relabel as R
from patchlight.plans.training_set import build_training_set, sample_check, write_training_set
from patchlight.session import work_dir
from patchlight.sources import run_store
from patchlight.sources.tables import materialise

TRAINING = "code, label, original_label, repo, pr_number"


def _weak(spark, sf, patterns):
    return T.examples(spark, sf).select(
        "pr_number", L.weak_label(F.col("explanation"), F.col("label"), patterns).alias("label")
    )


def _weak_sql(patterns):
    return f"""WITH {T.with_examples()}
        SELECT pr_number, {T.sql_weak_label('explanation', 'label', patterns)} AS label FROM examples"""


@check("F3", _weak_sql(C.WEAK_LABEL_PATTERNS))
def weak_labels(spark, sf):
    return _weak(spark, sf, C.WEAK_LABEL_PATTERNS)


@check("F3", _weak_sql(T.TEST_PATTERNS))
def weak_labels_test_words(spark, sf):
    return _weak(spark, sf, T.TEST_PATTERNS)


def _keywords(spark, sf, keywords):
    return T.documents(spark, sf).select(
        "doc_id", L.heuristic_label(F.col("text"), keywords).alias("category")
    )


def _keywords_sql(keywords):
    return f"SELECT doc_id, {T.sql_heuristic('text', keywords)} AS category FROM documents"


@check("F4", _keywords_sql(C.HEURISTIC_KEYWORDS))
def keyword_labels(spark, sf):
    return _keywords(spark, sf, C.HEURISTIC_KEYWORDS)


@check("F4", _keywords_sql(T.TEST_KEYWORDS))
def keyword_labels_test_words(spark, sf):
    return _keywords(spark, sf, T.TEST_KEYWORDS)


@check("F5", "SELECT doc_id, left(text, 2000) AS patch FROM documents")
def truncated_patches(spark, sf):
    return T.documents(spark, sf).select(
        "doc_id", first_chars(F.col("text"), C.MAX_PATCH_CHARS).alias("patch")
    )


def _filled(template, **values):
    parts, rest = [], template
    for name, value in values.items():
        head, rest = rest.split("{" + name + "}", 1)
        parts += [T.sql_lines(head), value]
    return " || ".join([*parts, T.sql_lines(rest)])


@check("F6 F7", f"SELECT doc_id, {_filled(C.JUDGE_PROMPT, code='left(text, 1500)')} AS prompt FROM documents")
def judge_prompts(spark, sf):
    return T.documents(spark, sf).select("doc_id", P.judge_prompt(F.col("text")).alias("prompt"))


@check(
    "F8",
    f"""WITH {T.with_findings()}
        SELECT {T.SQL_CHUNK_KEY} AS key,
               {_filled(C.FEEDBACK_PROMPT, category='category', chunk='chunk')} AS prompt FROM findings""",
)
def feedback_prompts(spark, sf):
    from patchlight.operators.findings import feedback_prompts as prompts

    return prompts(T.findings(spark, sf))


CATEGORY_OPENINGS = " ".join(f"WHEN '{c}' THEN {T.sql_lines(t)}" for c, t in C.CATEGORY_PROMPTS.items())


@check(
    "F8",
    f"""WITH {T.with_findings()}
        SELECT filename, chunk_index, CASE category {CATEGORY_OPENINGS} END || chunk AS prompt FROM findings""",
)
def category_prompts(spark, sf):
    return T.findings(spark, sf).select(
        "filename", "chunk_index", P.category_prompt(F.col("category"), F.col("chunk")).alias("prompt")
    )


@check(
    "F9",
    f"""WITH {T.with_labelled()}
        SELECT key, good_label AS label, CASE WHEN good_label IS NOT NULL THEN good_confidence END AS confidence
        FROM parsed""",
)
def parsed_replies(spark, sf):
    reply = F.col("response_text")
    return T.replies(spark, sf).select(
        "key", L.judge_label(reply).alias("label"), L.judge_confidence(reply).alias("confidence")
    )


@check(
    "F10",
    f"""WITH {T.with_labelled()}
        SELECT key, coalesce(good_label, 'PARSE_FAILED') AS label,
               CASE WHEN good_label IS NOT NULL THEN good_confidence ELSE 'none' END AS confidence
        FROM parsed WHERE response_text IS NOT NULL""",
)
def marked_replies(spark, sf):
    reply = F.col("response_text")
    return T.replies(spark, sf).where(reply.isNotNull()).select(
        "key", R.label_or_failed(reply).alias("label"), R.confidence_or_none(reply).alias("confidence")
    )


@check(
    "F11",
    f"""WITH {T.with_training()}
        SELECT pr_number, CAST({T.SQL_CLASS_INDEX} - 1 AS INTEGER) AS idx, label AS category FROM training""",
)
def category_indices(spark, sf):
    return T.training(spark, sf).select(
        "pr_number", L.category_index(F.col("label")).alias("idx")
    ).withColumn("category", L.category_of(F.col("idx")))


PROBABILITY_LIST = "[p1, p2, p3, p4, p5]"


@check(
    "F12",
    f"""WITH {T.with_probabilities()}
        SELECT vec_id, ['bug','style','performance','security','ok'][list_position({PROBABILITY_LIST}, list_max({PROBABILITY_LIST}))] AS category,
               round(list_max({PROBABILITY_LIST}), 6) AS confidence FROM probabilities""",
)
def top_probabilities(spark, sf):
    return T.probabilities(spark, sf).select(
        "vec_id",
        L.top_category(F.col("p")).alias("category"),
        F.round(L.top_confidence(F.col("p")), 6).alias("confidence"),
    )


# --- training set --------------------------------------------------------------


@check("P4 F5 E1", f"WITH {T.with_training()} SELECT {TRAINING} FROM training")
def training_set(spark, sf):
    return build_training_set(T.examples(spark, sf), T.TEST_PATTERNS)


@check("P4 E1", f"WITH {T.with_training(C.WEAK_LABEL_PATTERNS)} SELECT {TRAINING} FROM training")
def training_set_default_words(spark, sf):
    return build_training_set(T.examples(spark, sf))


def _counts(spark, counts):
    return spark.createDataFrame(sorted(counts.items()), "metric string, n bigint")


@check(
    "P4 E1",
    f"""WITH {T.with_training()}
        SELECT 'examples' AS metric, count(*) AS n FROM examples
        UNION ALL SELECT 'rejected', count(*) FILTER (patch IS NULL) FROM examples
        UNION ALL SELECT c.name, (SELECT count(*) FROM training WHERE label = c.name)
                  FROM (SELECT unnest({C.CATEGORIES}) AS name) c""",
)
def training_set_counts(spark, sf):
    """What the pass that writes the training set has counted."""
    return _counts(spark, write_training_set(T.examples(spark, sf), work_dir(spark, "training"), T.TEST_PATTERNS))


@check(
    "A6 O1",
    f"WITH {T.with_training()} SELECT label, count(*) AS n FROM training GROUP BY label ORDER BY n DESC, label",
)
def label_distribution(spark, sf):
    return D.distribution(T.training(spark, sf), "label")


@check(
    "O4",
    f"""WITH {T.with_training()},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pr_number) AS place,
                          count(*) OVER (PARTITION BY label) AS n FROM training)
        SELECT label AS category, n, pr_number, repo, left(code, 200) || '...' AS preview
        FROM ranked WHERE place = 1""",
)
def sample_per_category(spark, sf):
    return sample_check(T.training(spark, sf), "pr_number")


# --- relabelling -----------------------------------------------------------------


@check("P5", f"WITH {T.with_training()} SELECT repo, pr_number FROM training WHERE code <> ''")
def rows_with_code(spark, sf):
    return filters.with_code(T.training(spark, sf)).select("repo", "pr_number")


@check(
    "P7",
    f"""WITH {T.with_training()}
        SELECT repo, pr_number, CAST(NULL AS VARCHAR) AS judge_label,
               CAST(NULL AS VARCHAR) AS judge_confidence FROM training""",
)
def unlabelled_columns(spark, sf):
    return filters.unlabelled_columns(T.training(spark, sf)).select(
        "repo", "pr_number", "judge_label", "judge_confidence"
    )


LABELLED = "repo, pr_number, label, judge_label, judge_confidence"


def _labelled(spark, sf):
    return T.labelled(spark, sf).select("code", *LABELLED.split(", "))


def _labelled_sql(where):
    return f"WITH {T.with_labelled()} SELECT {LABELLED} FROM labelled WHERE {where}"


@check("P6", _labelled_sql("code <> '' AND judge_label IN ('bug','style','performance','security','ok')"))
def trainable_rows(spark, sf):
    return filters.trainable(_labelled(spark, sf)).drop("code")


@check("P8", _labelled_sql("judge_label IS NULL"))
def pending_rows(spark, sf):
    return filters.pending(_labelled(spark, sf)).drop("code")


@check("P9", _labelled_sql("judge_label IS DISTINCT FROM 'PARSE_FAILED'"))
def parsed_rows(spark, sf):
    return filters.parsed(_labelled(spark, sf)).drop("code")


@check("P10", _labelled_sql("judge_confidence = 'high'"))
def high_confidence_rows(spark, sf):
    return filters.high_confidence(_labelled(spark, sf)).drop("code")


@check("J2", f"WITH {T.with_done()} SELECT key, repo, pr_number FROM keyed WHERE key NOT IN (SELECT key FROM done)")
def unlabelled_keys(spark, sf):
    rows = R.with_key(T.training(spark, sf)).select("key", "repo", "pr_number")
    return R.not_done(rows, T.done(spark, sf))


@check(
    "J3",
    f"""WITH {T.with_labelled()}
        SELECT k.key, repo, pr_number, response_text, error
        FROM keyed k LEFT JOIN replies r ON k.key = r.key""",
)
def rows_with_replies(spark, sf):
    rows = R.with_key(T.training(spark, sf)).select("key", "repo", "pr_number")
    return R.attach_replies(rows, T.replies(spark, sf)).drop("attempts")


@check(
    "E2",
    f"""WITH {T.with_done()}
        SELECT key, {_filled(C.JUDGE_PROMPT, code='left(code, 1500)')} AS prompt
        FROM keyed WHERE code <> '' AND key NOT IN (SELECT key FROM done)""",
)
def pending_prompts(spark, sf):
    return R.prompts(T.training(spark, sf), T.done(spark, sf))


@check(
    "E3",
    f"""WITH {T.with_labelled()}
        SELECT key, {LABELLED} FROM labelled
        WHERE judge_label IS NOT NULL AND key NOT IN (SELECT key FROM done)""",
)
def label_run(spark, sf):
    run = R.label_run(T.training(spark, sf), T.done(spark, sf), T.replies(spark, sf))
    return run.select("key", *LABELLED.split(", "))


def _written(spark, sf):
    """The training table, written once: runs and their store read it many times, and its texts are dealt out when it is made."""
    return materialise(T.training(spark, sf), "training")


def _store(spark, sf, training):
    """The keys that are done, in the finished runs of a store: two of three compacted, one written twice, one left unfinished."""
    path = work_dir(spark, "store")
    done = materialise(T.done(spark, sf, training), "done").withColumn("judge_confidence", F.lit(C.NO_CONFIDENCE))
    part = F.pmod(F.xxhash64("key"), F.lit(3))
    run_store.add_run(done.where(part < 2), path, "first", buckets=4)
    run_store.add_run(done.where(part == 0), path, "first")
    run_store.add_run(done.where(part == 1), path, "second")
    run_store.compact(spark, path)
    run_store.add_run(done.where(part == 2), path, "third")
    R.with_key(training).select("key").write.parquet(f"{path}/runs/folder=unfinished")
    return path


@check("J2 S7", f"WITH {T.with_done()} SELECT DISTINCT key FROM keyed WHERE key NOT IN (SELECT key FROM done)")
def open_keys_of_runs(spark, sf):
    """What is left to label after the finished runs of a bucketed store."""
    training = _written(spark, sf)
    path, rows = _store(spark, sf, training), R.with_key(training)
    return R.open_keys(rows, run_store.decisions(spark, path), run_store.bucket_count(spark, path))


RUN_COUNTS = f"""WITH {T.with_labelled()},
        open AS (SELECT * FROM labelled WHERE code <> '' AND key NOT IN (SELECT key FROM done))"""


@check(
    "E3 A9 S7",
    f"""{RUN_COUNTS}
        SELECT 'written' AS metric, count(judge_label) AS n FROM open
        UNION ALL SELECT 'failed', count(*) FILTER (judge_label = 'PARSE_FAILED') FROM open
        UNION ALL SELECT 'agreed', count(*) FILTER (judge_label = label) FROM open
        UNION ALL SELECT 'pending', count(*) FILTER (judge_label IS NULL) FROM open""",
)
def label_run_counts(spark, sf):
    """What the pass that writes a run has counted; the run is written twice and counts once."""
    training = _written(spark, sf)
    replies = materialise(T.replies(spark, sf, training), "replies")
    store, path = _store(spark, sf, training), work_dir(spark, "labelled")
    for _ in range(2):
        counts = R.write_label_run(training, replies, path, store, "fourth")
    return _counts(spark, counts)


@check(
    "A8 A9 E4",
    f"""WITH {T.with_labelled()}, valid AS (SELECT * FROM labelled WHERE judge_label IS DISTINCT FROM 'PARSE_FAILED')
        SELECT 'rows' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM labelled
        UNION ALL SELECT 'valid', '', count(*) FROM valid
        UNION ALL SELECT 'failed', '', count(*) FILTER (judge_label = 'PARSE_FAILED') FROM labelled
        UNION ALL SELECT 'done', '', count(judge_label) FROM labelled
        UNION ALL SELECT 'label', judge_label, count(*) FROM valid WHERE judge_label IS NOT NULL GROUP BY judge_label
        UNION ALL SELECT 'confidence', judge_confidence, count(*) FROM valid
                  WHERE judge_confidence IS NOT NULL GROUP BY judge_confidence
        UNION ALL SELECT 'agreement', '', round(100.0 * avg(CASE WHEN judge_label = label THEN 1 ELSE 0 END), 6) FROM valid""",
)
def label_audit(spark, sf):
    return R.audit(T.labelled(spark, sf)).withColumn("value", F.round("value", 6))


@check(
    "A7",
    f"""WITH {T.with_labelled()}
        SELECT judge_confidence, count(*) AS n FROM labelled
        WHERE judge_label IS DISTINCT FROM 'PARSE_FAILED' AND judge_confidence IS NOT NULL GROUP BY judge_confidence""",
)
def confidence_distribution(spark, sf):
    return D.distribution(filters.parsed(T.labelled(spark, sf)), "judge_confidence")
