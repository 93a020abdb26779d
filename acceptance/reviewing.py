"""Findings, roll-ups, reports and the continuous review."""

from pyspark.sql import functions as F

from acceptance import tables as T
from acceptance.registry import check
from patchlight import constants as C
from patchlight import schemas
from patchlight.functions import display
from patchlight.functions.labels import top_category, top_confidence
from patchlight.operators import distributions as D
from patchlight.operators import filters, rollups
from patchlight.operators.chunks import explode_chunks
from patchlight.operators import findings as FI
from patchlight.plans.review import by_keywords, find, respond, review
from patchlight.session import work_dir
from patchlight.sources import changed_files as S1
from patchlight.sources.tables import materialise, with_row_id
from patchlight.streaming import continuous_review as S

LABEL = by_keywords(T.TEST_KEYWORDS)
FINDING = "review_key, filename, language, chunk_index, chunk, category, confidence"

FIVE = "(SELECT unnest(['bug','style','performance','security','ok']) AS c, unnest([0, 1, 2, 3, 4]) AS i)"


@check("E5", f"WITH {T.with_findings()} SELECT {FINDING} FROM findings")
def review_findings(spark, sf):
    return find(T.files(spark, sf), LABEL).select(*FINDING.split(", "))


@check("E5", f"WITH {T.with_findings(30, C.HEURISTIC_KEYWORDS)} SELECT {FINDING} FROM findings")
def review_findings_default_words(spark, sf):
    return find(T.files(spark, sf)).select(*FINDING.split(", "))


BOTH_SOURCES = T.with_records() + f""",
    files AS (SELECT review_key, filename, {T.SQL_LANGUAGE} AS language, patch FROM records
              UNION ALL SELECT 'page ' || page_id, 'pasted_code', 'Unknown', html FROM pages)"""


@check("E5 U1", f"WITH {T.with_findings(30, T.TEST_KEYWORDS, BOTH_SOURCES)} SELECT {FINDING} FROM findings")
def review_of_all_inputs(spark, sf):
    """Landed review records and the sources of the pages as pasted code, in one review run."""
    raw = T.pages(spark, sf).select(
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("review_key"),
        F.col("html").alias("code"),
        F.lit(None).cast("string").alias("filename"),
    )
    usable, _ = S1.split_blank_code(raw)
    files = S1.all_inputs(S1.from_pr_files(T.pr_records(spark, sf)), S1.from_raw_code(usable))
    return find(files, LABEL).select(*FINDING.split(", "))


@check(
    "A1",
    f"""WITH {T.with_findings()}
        SELECT c AS category, CAST(i AS INTEGER) AS idx, count(category) AS n
        FROM {FIVE} d LEFT JOIN findings f ON d.c = f.category GROUP BY c, i""",
)
def category_counts(spark, sf):
    return D.category_counts(T.findings(spark, sf))


@check(
    "A1",
    f"""WITH {T.with_findings()}
        SELECT r.review_key, c AS category, CAST(i AS INTEGER) AS idx, count(f.category) AS n
        FROM (SELECT DISTINCT review_key FROM findings) r CROSS JOIN {FIVE} d
        LEFT JOIN findings f ON d.c = f.category AND r.review_key = f.review_key GROUP BY r.review_key, c, i""",
)
def category_counts_by_review(spark, sf):
    return D.category_counts(T.findings(spark, sf), "review_key")


@check(
    "A2",
    f"""WITH {T.with_findings()}
        SELECT review_key, count(*) AS total_chunks, count(*) FILTER (category <> 'ok') AS total_issues
        FROM findings GROUP BY review_key""",
)
def review_totals(spark, sf):
    return D.totals(T.findings(spark, sf), "review_key")


SUMMARY_ORDER = "list_position(['bug','security','performance','style'], category)"


def _summary_sql(keys):
    head = "".join(f"{k}, " for k in keys)
    return f"""WITH {T.with_findings()}
        SELECT {head}category, count(*) AS n, count(DISTINCT filename) AS n_files,
               left(array_to_string(list_sort(list(DISTINCT filename)), ', '), 28) AS files,
               {SUMMARY_ORDER} AS ord
        FROM findings WHERE category <> 'ok' GROUP BY {head}category"""


def _typed(summary):
    return summary.withColumn("ord", F.col("ord").cast("int"))


@check("A3 O3", _summary_sql([]))
def category_summary(spark, sf):
    return _typed(rollups.summary(T.findings(spark, sf)))


@check("A3 O3", _summary_sql(["review_key"]))
def category_summary_by_review(spark, sf):
    return _typed(rollups.summary(T.findings(spark, sf), "review_key"))


@check(
    "U3 A3",
    f"""WITH {T.with_findings()}
        SELECT category, filename, count(*) AS n FROM findings WHERE category <> 'ok' GROUP BY category, filename""",
)
def files_per_category(spark, sf):
    return rollups.files_per_category(T.findings(spark, sf))


SQL_FINDING = (
    "{'category': category, 'confidence': confidence, 'feedback': feedback, 'chunk': chunk, "
    "'chunk_index': chunk_index, 'filename': filename, 'language': language}"
)


@check(
    "A4",
    f"""WITH {T.with_findings()}
        SELECT f.review_key, f.filename, f.language, f.additions, f.deletions,
               CAST(coalesce(x.findings, '[]') AS VARCHAR) AS findings
        FROM files f LEFT JOIN (
            SELECT filename, to_json(list({SQL_FINDING} ORDER BY chunk_index)) AS findings
            FROM (SELECT *, '' AS feedback FROM findings) GROUP BY filename) x ON f.filename = x.filename""",
)
def file_results(spark, sf):
    results = rollups.label_files(T.files(spark, sf), keywords=T.TEST_KEYWORDS)
    return results.withColumn("findings", F.to_json("findings"))


@check(
    "A4 J4",
    f"""WITH {T.with_commented()}
        SELECT f.review_key, f.filename, f.language, f.additions, f.deletions,
               CAST(coalesce(x.findings, '[]') AS VARCHAR) AS findings
        FROM files f LEFT JOIN (
            SELECT filename, to_json(list({SQL_FINDING} ORDER BY chunk_index)) AS findings
            FROM commented GROUP BY filename) x ON f.filename = x.filename""",
)
def commented_file_results(spark, sf):
    findings = FI.attach_feedback(T.findings(spark, sf, 5), T.comments(spark, sf))
    nested = rollups.nest_findings(T.files(spark, sf), findings, "review_key", "filename")
    return nested.withColumn("findings", F.to_json("findings"))


def _counts_sql(findings: str = "findings", files: str = "files") -> str:
    """Totals of the reviews that have a file with a patch."""
    return f"""
    sizes AS (SELECT review_key, count(*) AS n_files FROM {files} WHERE patch <> '' GROUP BY review_key),
    counts AS (SELECT s.review_key, n_files, count(category) AS total_chunks,
                      count(*) FILTER (category <> 'ok') AS total_issues,
                      {', '.join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in C.CATEGORIES)}
               FROM sizes s LEFT JOIN {findings} f ON s.review_key = f.review_key GROUP BY s.review_key, n_files)"""


COUNTS = ["n_files", "total_chunks", "total_issues", *[f"n_{c}" for c in C.CATEGORIES]]
NESTED = f"""
    nested AS (SELECT f.doc_id, f.review_key, f.filename, f.language, f.additions, f.deletions,
                      list({SQL_FINDING} ORDER BY chunk_index) AS findings
               FROM (SELECT *, '' AS feedback FROM findings) f GROUP BY ALL)"""
FILE_JSON = """{'filename': filename, 'language': language, 'additions': additions, 'deletions': deletions, 'findings': findings}"""
TOTALS_JSON = f"""{{'n_files': n_files, 'total_chunks': total_chunks, 'total_issues': total_issues,
               'category_counts': {{{', '.join(f"'{c}': n_{c}" for c in C.CATEGORIES)}}}}}"""
ROWS_SQL = f"""SELECT review_key, 'file' AS kind, filename, len(findings) AS n_findings,
               {', '.join(f'CAST(NULL AS BIGINT) AS {c}' for c in COUNTS)} FROM nested
        UNION ALL SELECT review_key, 'totals', NULL, NULL, {', '.join(COUNTS)} FROM counts"""
DOCUMENTS_SQL = f"""SELECT review_key, 'file' AS kind, filename, CAST(to_json({FILE_JSON}) AS VARCHAR) AS json FROM nested
        UNION ALL SELECT review_key, 'totals', NULL, CAST(to_json({TOTALS_JSON}) AS VARCHAR) FROM counts"""


def _results(spark, sf):
    files = materialise(
        rollups.label_files(T.files(spark, sf), keywords=T.TEST_KEYWORDS), "file-results"
    )
    return rollups.review_results(files)


def _flat(results):
    totals = F.col("totals")
    sums = ["n_files", "total_chunks", "total_issues"]
    return results.select(
        "review_key", "kind", F.col("file.filename").alias("filename"),
        F.when(F.col("kind") == "file", F.size("file.findings").cast("bigint")).alias("n_findings"),
        *[totals[c].cast("bigint").alias(c) for c in sums],
        *[totals["category_counts"][c].cast("bigint").alias(f"n_{c}") for c in C.CATEGORIES],
    )


@check("A5", f"WITH {T.with_findings()}, {_counts_sql()}, {NESTED} {ROWS_SQL}")
def review_results(spark, sf):
    return _flat(_results(spark, sf))


@check("S8 A5", f"WITH {T.with_findings()}, {_counts_sql()}, {NESTED} {DOCUMENTS_SQL}")
def review_result_json(spark, sf):
    return rollups.result_json(_results(spark, sf))


RECORD_FILES = T.with_records() + f""",
    files AS (SELECT doc_id, review_key, filename, {T.SQL_LANGUAGE} AS language, patch,
                     coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions FROM records)"""
RECORD_FINDINGS = T.with_findings(30, T.TEST_KEYWORDS, RECORD_FILES)


@check(
    "A4",
    f"""WITH {RECORD_FINDINGS}, {NESTED}
        SELECT review_key, filename, language, additions, deletions, CAST(to_json(findings) AS VARCHAR) AS findings FROM nested""",
)
def record_file_results(spark, sf):
    """Landed records with files that have no patch and files of one name."""
    files = S1.from_pr_files(T.pr_records(spark, sf))
    return rollups.label_files(files, keywords=T.TEST_KEYWORDS).withColumn("findings", F.to_json("findings"))


@check(
    "A4",
    f"""WITH {RECORD_FINDINGS}, {NESTED}
        SELECT review_key, filename, language, additions, deletions, CAST(to_json(findings) AS VARCHAR) AS findings FROM nested""",
)
def record_nested_findings(spark, sf):
    """The same from the findings table, by the place of each file in the landed table."""
    files = with_row_id(materialise(S1.from_pr_files(T.pr_records(spark, sf)), "files"))
    found = find(files, LABEL).withColumn("feedback", F.lit(""))
    return rollups.nest_findings(files, found, "row_id").withColumn("findings", F.to_json("findings"))


@check("A5 E5", f"WITH {RECORD_FINDINGS}, {_counts_sql()}, {NESTED} {ROWS_SQL}")
def record_review_results(spark, sf):
    """From landed records to the response of each review."""
    return _flat(respond(T.pr_records(spark, sf), keywords=T.TEST_KEYWORDS))


@check("S8 E5", f"WITH {RECORD_FINDINGS}, {_counts_sql()}, {NESTED} {DOCUMENTS_SQL}")
def record_review_json(spark, sf):
    return rollups.result_json(respond(T.pr_records(spark, sf), keywords=T.TEST_KEYWORDS))


@check(
    "P11",
    f"WITH {T.with_findings()} SELECT filename, chunk_index, category FROM findings WHERE category <> 'ok'",
)
def actionable_findings(spark, sf):
    return filters.actionable(T.findings(spark, sf)).select("filename", "chunk_index", "category")


@check(
    "P12",
    f"""WITH {T.with_findings()}
        SELECT review_key, filename, language FROM files
        WHERE filename NOT IN (SELECT filename FROM findings WHERE category <> 'ok')""",
)
def clean_files(spark, sf):
    clean = filters.clean_files(T.files(spark, sf), T.findings(spark, sf), "review_key", "filename")
    return clean.select("review_key", "filename", "language")


@check(
    "P12",
    f"""WITH {RECORD_FINDINGS}
        SELECT review_key, filename, additions, deletions FROM files WHERE patch <> ''
        AND doc_id NOT IN (SELECT doc_id FROM findings WHERE category <> 'ok')""",
)
def clean_record_files(spark, sf):
    """Landed records: a clean file next to another of its name with an issue, and files without a patch, which are not shown."""
    files = S1.from_pr_files(T.records_with_ids(spark, sf))
    return filters.clean_files(files, find(files, LABEL)).select("review_key", "filename", "additions", "deletions")


UNCHECKED = """
    unchecked AS (SELECT f.filename, f.chunk_index, f.language, f.chunk, f.confidence,
                         CASE WHEN ends_with(f.filename, '.md') THEN 'docs' ELSE f.category END AS category,
                         CASE WHEN reply IS NOT NULL OR error IS NULL THEN f.feedback END AS feedback
                  FROM commented f LEFT JOIN comments c ON c.conv_id = f.doc_id AND c.turn = f.chunk_index)"""


def _unchecked(spark, sf):
    """Findings with faults: an unknown category in .md files, no comment where one failed."""
    rows = FI.attach_feedback(T.findings(spark, sf, 5), T.comments(spark, sf))
    failed = F.col("feedback").startswith("(feedback unavailable: asked by")
    return rows.withColumn(
        "category", F.when(F.col("filename").endswith(".md"), "docs").otherwise(F.col("category"))
    ).withColumn("feedback", F.when(~failed, F.col("feedback")))


@check(
    "P13",
    f"""WITH {T.with_commented()}, {UNCHECKED}
        SELECT filename, chunk_index, category FROM unchecked WHERE category <> 'docs' AND feedback IS NOT NULL""",
)
def valid_findings(spark, sf):
    valid, _ = filters.split_findings(_unchecked(spark, sf))
    return valid.select("filename", "chunk_index", "category")


@check(
    "P13",
    f"""WITH {T.with_commented()}, {UNCHECKED}
        SELECT filename, chunk_index,
               CASE WHEN category = 'docs' THEN 'unknown category' ELSE 'missing feedback' END AS reason
        FROM unchecked WHERE category = 'docs' OR feedback IS NULL""",
)
def rejected_findings(spark, sf):
    _, rejected = filters.split_findings(_unchecked(spark, sf))
    return rejected.select("filename", "chunk_index", "reason")


@check(
    "P15",
    f"WITH {T.with_findings(30, C.HEURISTIC_KEYWORDS)} SELECT category, count(*) AS n FROM findings WHERE category <> 'ok' GROUP BY category",
)
def shown_counts(spark, sf):
    counts = D.category_counts(T.findings(spark, sf, keywords=C.HEURISTIC_KEYWORDS))
    return D.shown_counts(counts).select("category", "n")


@check(
    "J4 F15",
    f"WITH {T.with_commented()} SELECT {FINDING}, feedback FROM commented",
)
def findings_with_comments(spark, sf):
    found = review(T.files(spark, sf), T.comments(spark, sf), LABEL, 5)
    return found.select(*FINDING.split(", "), "feedback")


def _plain(text):
    """Clean-up of a comment in DuckDB's dialect."""
    unfenced = f"regexp_replace(regexp_replace({text}, '```[a-z]*\\n?', '', 'g'), '```', '', 'g')"
    unquoted = f"regexp_replace({unfenced}, '`([^`]+)`', '\\1', 'g')"
    return f"regexp_replace({unquoted}, '^\\s+|\\s+$', '', 'g')"


@check("F14", f"WITH {T.with_commented()} SELECT filename, chunk_index, {_plain('feedback')} AS comment FROM commented")
def plain_feedback(spark, sf):
    rows = FI.attach_feedback(T.findings(spark, sf, 5), T.comments(spark, sf))
    return rows.select(
        "filename", "chunk_index", display.plain_feedback(F.col("feedback")).alias("comment")
    )


@check(
    "F13",
    f"""WITH {T.with_commented()}, {T.with_probabilities().lstrip()},
        shown AS (SELECT f.* EXCLUDE (confidence),
                         coalesce(round(list_max([p1, p2, p3, p4, p5]), 6), 0) AS confidence
                  FROM commented f LEFT JOIN probabilities p ON f.doc_id = p.vec_id)
        SELECT review_key, filename, chunk_index + 1 AS chunk_number, upper(category) AS heading,
               CASE category WHEN 'ok' THEN 'Clean' ELSE upper(left(category, 1)) || substr(category, 2) END AS category_name,
               CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS percent,
               CAST(round_even(confidence * 100, 0) AS INTEGER) AS percent_even,
               CASE WHEN confidence > 0 THEN CAST(round_even(confidence * 100, 0) AS INTEGER) || '% confidence'
                    ELSE 'heuristic' END AS confidence_text,
               {_plain('feedback')} AS comment, left(chunk, 200) || '...' AS preview
        FROM shown""",
)
def findings_report(spark, sf):
    rows = FI.attach_feedback(T.findings(spark, sf, 5), T.comments(spark, sf)).drop("confidence")
    scores = T.probabilities(spark, sf).select(
        F.col("vec_id").alias("doc_id"), F.round(F.array_max("p"), 6).alias("p")
    )
    scored = rows.join(scores, "doc_id", "left").withColumn("confidence", F.coalesce("p", F.lit(0.0)))
    return FI.report(scored, include_ok=True)


def _stream(spark, sf):
    """The documents table, a file or a folder of files, as a folder in which files land.

    A pattern that only this name fits stands for both; a stream takes no plain path of a single file.
    """
    docs = S.landing_folder(
        spark,
        f"{sf}/documents.parque[t]",
        "parquet",
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    return T.files_of(docs)


@check("E6", f"WITH {T.with_findings()} SELECT {FINDING} FROM findings")
def continuous_review_findings(spark, sf):
    path, checkpoint = work_dir(spark, "findings"), work_dir(spark, "checkpoint")
    S.write_findings(_stream(spark, sf), path, checkpoint, LABEL).awaitTermination()
    return spark.read.parquet(path).select(*FINDING.split(", "))


@check("E6", f"WITH {T.with_findings()} SELECT category, count(*) AS n FROM findings GROUP BY category")
def continuous_review_counts(spark, sf):
    path, checkpoint, state = (work_dir(spark, name) for name in ("findings", "checkpoint", "counts"))
    S.write_findings(_stream(spark, sf), path, checkpoint, LABEL).awaitTermination()
    S.count_findings(spark, path, state).awaitTermination()
    return S.running_counts(spark, state)


FIRST, SECOND = "2026-01-01", "2026-01-02"
# The first landing has all files. In the second, every other review lands again, without the second of its three files.
AGAIN = "doc_id // 3 % 2 = 0 AND doc_id % 3 <> 1"
LANDED = T.with_records() + f""",
    landed AS (SELECT * FROM records WHERE doc_id // 3 % 2 = 1 OR ({AGAIN})),
    files AS (SELECT doc_id, review_key, filename, {T.SQL_LANGUAGE} AS language, patch,
                     coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions FROM landed)"""


def _landings(spark, sf):
    """Records of the two landings, the second one in other words for the same condition."""
    rows = T.pr_records(spark, sf, F.col("doc_id"))
    again = rows.where((F.floor(F.col("doc_id") / 3) % 2 == 0) & (F.col("doc_id") % 3 != 1))
    return [landed.drop("doc_id").withColumn("landing", F.lit(name)) for landed, name in ((rows, FIRST), (again, SECOND))]


@check("S1 A5", f"WITH {T.with_findings(30, T.TEST_KEYWORDS, LANDED)}, {_counts_sql()}, {NESTED} {ROWS_SQL}")
def last_landing_results(spark, sf):
    """A review that lands again, with a file gone, is answered by its last landing alone."""
    first, second = _landings(spark, sf)
    return _flat(respond(first.unionByName(second), keywords=T.TEST_KEYWORDS))


def _two_runs(spark, sf):
    """Both landings through the stream, each in a run of its own: the second goes on from the checkpoints of the first."""
    landing, path, checkpoint, state = (work_dir(spark, name) for name in ("landing", "findings", "checkpoint", "counts"))
    for landed in _landings(spark, sf):
        landed.write.mode("append").parquet(landing)
        records = S.landing_folder(spark, landing, "parquet", f"{schemas.PR_FILES}, landing string")
        S.write_findings(S1.from_pr_files(records), path, checkpoint, LABEL).awaitTermination()
        S.count_findings(spark, path, state, "review_key", "landing").awaitTermination()
    return state


@check(
    "E6",
    f"""WITH {RECORD_FINDINGS}
        SELECT category, count(*) + count(*) FILTER ({AGAIN}) AS n FROM findings GROUP BY category""",
)
def running_counts_after_restart(spark, sf):
    """Everything that has landed in two runs, from the state alone."""
    counts = S.running_counts(spark, _two_runs(spark, sf))
    return counts.groupBy("category").agg(F.sum("n").alias("n"))


@check(
    "E6 A5",
    f"WITH {T.with_findings(30, T.TEST_KEYWORDS, LANDED)} SELECT review_key, category, count(*) AS n FROM findings GROUP BY ALL",
)
def current_counts_of_reviews(spark, sf):
    """The counts of each review as it stands: reviews that landed again count by their last landing."""
    return S.current_counts(spark, _two_runs(spark, sf), "review_key")


SCORED_COMMENTED = T.with_findings(5, T.TEST_KEYWORDS, RECORD_FILES) + f""",
    {T.with_probabilities().lstrip()},
    scored AS (SELECT vec_id, ['bug','style','performance','security','ok'][list_position([p1, p2, p3, p4, p5], list_max([p1, p2, p3, p4, p5]))] AS category,
                      round(list_max([p1, p2, p3, p4, p5]), 6) AS confidence FROM probabilities),
    comments AS (SELECT conv_id, turn,
                        CASE WHEN role = 'assistant' THEN ' ```py' || chr(10) || text || '```  use `it` ' || chr(10) END AS reply,
                        CASE WHEN role <> 'assistant' THEN 'asked by ' || role END AS error FROM conversations),
    answered AS (SELECT f.* EXCLUDE (category, confidence), coalesce(s.category, f.category) AS category, coalesce(s.confidence, 0) AS confidence,
                        coalesce(regexp_replace(reply, '^\\s+|\\s+$', '', 'g'), '(feedback unavailable: ' || coalesce(error, 'no reply') || ')') AS feedback
                 FROM findings f LEFT JOIN scored s ON s.vec_id = f.doc_id
                 LEFT JOIN comments c ON c.conv_id = f.doc_id AND c.turn = f.chunk_index),
    nested AS (SELECT doc_id, review_key, filename, language, additions, deletions, list({SQL_FINDING} ORDER BY chunk_index) AS findings
               FROM answered GROUP BY ALL)"""


@check("E5 M8 J4", f"WITH {SCORED_COMMENTED}, {_counts_sql('answered')} {DOCUMENTS_SQL}")
def model_response_json(spark, sf):
    """The response with a model's categories and confidences and with comments, names that repeat included.

    The probabilities are recorded ones, one vector a file; a file without one is labelled by keywords.
    """
    scores = T.probabilities(spark, sf).select(
        F.col("vec_id").cast("string").alias("file_id"),
        F.struct(top_category(F.col("p")).alias("category"), F.round(top_confidence(F.col("p")), 6).alias("confidence")).alias("scored"),
    )

    def label(chunks):
        rows = LABEL(chunks).join(scores, "file_id", "left")
        return rows.select(
            *chunks.columns,
            F.coalesce("scored.category", "category").alias("category"),
            F.coalesce("scored.confidence", "confidence").alias("confidence"),
        )

    records = T.records_with_ids(spark, sf)
    chunks = explode_chunks(S1.with_patch(S1.from_pr_files(records)), 5)
    replies = T.comments(spark, sf, chunks.withColumn("doc_id", F.col("file_id").cast("bigint")))
    return rollups.result_json(respond(records, replies, label, 5))
