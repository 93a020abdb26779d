"""Stand-ins for the inputs of the library, made from the driver's tables.

For each there is a Spark form and a SQL form with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.labels import heuristic_label, weak_label
from patchlight.functions.naming import language
from patchlight.functions.text import content_key, first_chars
from patchlight.operators.chunks import explode_chunks
from patchlight.operators.folds import assign_folds
from patchlight.operators.findings import label_by_keywords, with_chunk_key
from patchlight.operators.relabel import latest_replies, read_replies, with_key
from patchlight.plans.training_set import build_training_set
from patchlight.sources.tables import materialise

# Word lists that the invented prose of the test tables does contain.
TEST_KEYWORDS = {
    "bug": ["nan", "none"],
    "security": ["hash", "token"],
    "performance": ["thor", "erin"],
    "style": ["anea", "thnt"],
}
TEST_PATTERNS = {
    "security": [r"\bhash\w*\b", r"\btoken\b", r"\bque\b"],
    "bug": [r"\bnan\w*\b", r"\bpa\b"],
    "performance": [r"\bthor\w*\b", r"\berin\w*\b"],
    "style": [r"\banea\w*\b", r"\bthnt\b"],
}

# File extension of a document by its number.
EXTENSIONS = [".py", ".ts", ".rs", ".cpp", ".go", ".md", ".SQL", ""]


# --- Spark -------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    # The test files are single row groups; dealing the rows out is a shuffle at every size.
    return spark.read.schema(schema).parquet(f"{sf}/documents.parquet").repartition("doc_id")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, quality int, toxic int").parquet(f"{sf}/labels.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    schema = "page_id bigint, url string, html string"
    return spark.read.schema(schema).parquet(f"{sf}/pages.parquet")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    schema = "conv_id bigint, turn bigint, role string, text string"
    return spark.read.schema(schema).parquet(f"{sf}/conversations.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    schema = "vec_id bigint, embedding array<float>, label int"
    return spark.read.schema(schema).parquet(f"{sf}/embeddings.parquet")


def filename() -> F.Column:
    extension = F.element_at(
        F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int")
    )
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), extension)


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as changed files of the review named by their source."""
    return files_of(documents(spark, sf))


def files_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("source").alias("review_key"),
        filename().alias("filename"),
        language(filename()).alias("language"),
        F.col("text").alias("patch"),
        (F.col("n_chars") % 100).cast("int").alias("additions"),
        (F.col("n_chars") % 7).cast("int").alias("deletions"),
    )


def chunks(spark: SparkSession, sf: str, max_lines: int = C.MAX_CHUNK_LINES) -> DataFrame:
    return explode_chunks(files(spark, sf), max_lines)


def findings(
    spark: SparkSession, sf: str, max_lines: int = C.MAX_CHUNK_LINES, keywords=None
) -> DataFrame:
    return label_by_keywords(chunks(spark, sf, max_lines), keywords or TEST_KEYWORDS)


def records_with_ids(spark: SparkSession, sf: str) -> DataFrame:
    """``pr_records`` with the number of the document as the id of the file."""
    return pr_records(spark, sf, F.col("doc_id").cast("string").alias("file_id"))


def pr_records(spark: SparkSession, sf: str, *more: F.Column) -> DataFrame:
    """Landed review records: three documents to a review.

    One file in ten has no patch, nor has any of every fiftieth review; in every tenth review two files have one name,
    and one file in seven comes without counts.
    """
    review = F.floor(F.col("doc_id") / 3)
    bare = (F.col("doc_id") % 10 == 3) | (review % 50 == 7)
    name = F.when((review % 10 == 4) & (F.col("doc_id") % 3 < 2), "twice.py").otherwise(filename())
    counted = F.col("doc_id") % 7 > 0
    return documents(spark, sf).select(
        *more,
        F.concat(F.lit("https://github.com/acme/web/pull/"), review.cast("string"), F.lit("/files")).alias("pr_url"),
        name.alias("filename"),
        F.when(~bare, F.col("text")).alias("patch"),
        F.when(counted, (F.col("n_chars") % 100).cast("int")).alias("additions"),
        F.when(counted, (F.col("n_chars") % 7).cast("int")).alias("deletions"),
    )


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Review addresses from the https pages, other addresses from the rest."""
    url = F.col("url")
    built = F.concat(
        F.lit("https://github.com/"),
        F.regexp_extract(url, "//([^/]+)/([^/]+)/", 1),
        F.lit("/"),
        F.regexp_extract(url, "//([^/]+)/([^/]+)/", 2),
        F.lit("/pull/"),
        F.col("page_id").cast("string"),
    )
    return pages(spark, sf).select(
        "page_id", F.when(url.startswith("https:"), built).otherwise(url).alias("pr_url")
    )


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """Review examples: quality 1 counts as an approval, anything else asks for changes."""
    verdict = F.when(F.col("quality") == 1, C.APPROVED).otherwise("REQUEST_CHANGES")
    return (
        documents(spark, sf)
        .join(labels(spark, sf), "doc_id", "left")
        .select(
            F.col("text").alias("explanation"),
            verdict.alias("label"),
            F.col("text").alias("patch"),
            F.col("source").alias("repo"),
            F.col("doc_id").alias("pr_number"),
        )
    )


def training(spark: SparkSession, sf: str, patterns=None) -> DataFrame:
    return build_training_set(examples(spark, sf), patterns or TEST_PATTERNS)


def done(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Keys of an earlier run: the documents that labels calls toxic. ``of`` is the training table where it is written."""
    toxic = labels(spark, sf).where("toxic = 1").select(F.col("doc_id").alias("pr_number"))
    rows = training(spark, sf) if of is None else of
    return with_key(rows.join(toxic, "pr_number", "left_semi")).select(
        "key", F.lit(C.PARSE_FAILED).alias("judge_label")
    )


def replies(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Judge replies of six kinds for the documents in labels; none for the others. ``of`` is as in ``done``."""
    text = F.array(
        *[F.lit(t) for t in REPLY_TEXTS]
    )
    known = labels(spark, sf).select(F.col("doc_id").alias("pr_number"))
    kind = (F.length("code") % 6).cast("int")
    rows = training(spark, sf) if of is None else of
    return with_key(rows.join(known, "pr_number", "left_semi")).select(
        "key",
        F.get(text, kind).alias("response_text"),
        F.when(kind == 5, "timeout").alias("error"),
        F.when(kind == 5, (F.col("pr_number") % 5).cast("int")).otherwise(1).alias("attempts"),
    )


# Kind 5 has no text.
REPLY_TEXTS = [
    "LABEL: bug\nCONFIDENCE: high",
    "label:Security",
    "Sure.\nLABEL:\n\n ok\nConfidence: LOW",
    "LABEL: bug_fix",
    "nothing",
]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with the labels read from the replies; the rest is pending."""
    answers = latest_replies(replies(spark, sf))
    return read_replies(with_key(training(spark, sf)), answers)


def comments(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Recorded comments: turn n of a conversation answers chunk n (of five lines) of the document of its number."""
    keyed = with_chunk_key(chunks(spark, sf, 5) if of is None else of)
    turns = conversations(spark, sf).select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), "role", "text"
    )
    reply = F.when(
        F.col("role") == "assistant",
        F.concat(F.lit(" ```py\n"), F.col("text"), F.lit("```  use `it` \n")),
    )
    return keyed.select("doc_id", "chunk_index", "chunk_key").join(turns, ["doc_id", "chunk_index"]).select(
        F.col("chunk_key").alias("key"),
        reply.alias("response_text"),
        F.when(F.col("role") != "assistant", F.concat(F.lit("asked by "), F.col("role"))).alias("error"),
        F.lit(1).alias("attempts"),
    )


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax of five sums over each embedding: entry i counts for class i modulo 5."""

    def total_of(k: int) -> F.Column:
        entries = F.filter("embedding", lambda _, i: i % 5 == k)
        return F.aggregate(entries, F.lit(0.0), lambda a, x: a + x.cast("double"))

    powers = F.transform(F.array(*map(total_of, range(5))), lambda x: F.exp(x))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return (
        embeddings(spark, sf)
        .select("vec_id", powers.alias("e"))
        .select("vec_id", F.transform("e", lambda x: x / total).alias("p"))
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Weak label against keyword label of each document, in five folds."""
    rows = examples(spark, sf).select(
        F.col("pr_number").cast("string").alias("key"),
        weak_label(F.col("explanation"), F.col("label"), TEST_PATTERNS).alias("label"),
        heuristic_label(F.col("patch"), TEST_KEYWORDS).alias("prediction"),
    )
    return assign_folds(materialise(rows, "pairs"), "key")


def code_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with their weak label, as input of the classifier."""
    rows = training(spark, sf).select(F.col("pr_number").alias("key"), "code", "label")
    return materialise(rows, "training")


# --- SQL ---------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_lines(value: str) -> str:
    """A text literal that may hold line ends."""
    return " || chr(10) || ".join(sql_text(part) for part in value.split("\n"))


def sql_pattern(pattern: str) -> str:
    """RE2 form of a weak-label pattern."""
    head = f"(^|{OTHER})"
    tail = f"({OTHER}|$)"
    body = pattern.removeprefix(r"\b")
    end = body.endswith(r"\b")
    body = body.removesuffix(r"\b")
    body = body.replace(r"\w", WORD)
    return head + "(" + body + ")" + (tail if end else "")


def sql_weak_label(text: str, verdict: str, patterns: dict) -> str:
    def any_of(ps: list[str]) -> str:
        return " OR ".join(f"regexp_matches(lower({text}), {sql_text(sql_pattern(p))})" for p in ps)

    cases = " ".join(f"WHEN {any_of(patterns[c])} THEN '{c}'" for c in C.WEAK_LABEL_PRIORITY)
    return f"CASE WHEN {verdict} = 'APPROVE' THEN 'ok' {cases} ELSE 'bug' END"


def sql_hits(text: str, keywords: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {sql_text(k)})::INT" for k in keywords) + ")"


def sql_heuristic(text: str, keywords: dict) -> str:
    """A scalar expression over one text column."""
    hits = {c: sql_hits(f"lower({text})", keywords[c]) for c in keywords}
    top = "greatest(" + ", ".join(hits.values()) + ")"
    cases = " ".join(f"WHEN {hits[c]} = {top} THEN '{c}'" for c in C.CATEGORIES if c in hits)
    return f"CASE WHEN {top} = 0 THEN 'ok' {cases} END"


SQL_EXTENSION = "CASE doc_id % 8 " + " ".join(
    f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS)
) + " END"

SQL_LANGUAGE = (
    "CASE lower(regexp_extract(filename, '\\.([^.]*)$', 1)) "
    + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in C.LANGUAGE_BY_EXTENSION.items())
    + " ELSE 'Unknown' END"
)

def sql_key(*columns: str) -> str:
    fields = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns]
    return "sha256(" + " || ".join(fields) + ")"


SQL_PREDICTED_KEY = sql_key("repo", "pr_number", "original_label", "code")


def with_files() -> str:
    return f"""
    named AS (SELECT *, source || '/' || doc_id || {SQL_EXTENSION} AS filename FROM documents),
    files AS (SELECT doc_id, source AS review_key, filename, {SQL_LANGUAGE} AS language, text AS patch,
                     CAST(n_chars % 100 AS INTEGER) AS additions, CAST(n_chars % 7 AS INTEGER) AS deletions
              FROM named)"""


def with_chunks(k: int = C.MAX_CHUNK_LINES, files: str | None = None) -> str:
    """Chunks of the table files, or of another definition of it."""
    return (files or with_files()) + f""",
    lines AS (SELECT * EXCLUDE (patch), string_split(
                 CASE WHEN ends_with(patch, chr(10)) THEN left(patch, length(patch) - 1) ELSE patch END, chr(10)) AS ls
              FROM files WHERE patch <> ''),
    cuts AS (SELECT *, unnest(range(0, (len(ls) + {k - 1}) // {k})) AS i FROM lines),
    chunks AS (SELECT * EXCLUDE (ls, i), CAST(i AS INTEGER) AS chunk_index,
                      array_to_string(ls[i * {k} + 1 : i * {k} + {k}], chr(10)) AS chunk FROM cuts)"""


def with_findings(
    k: int = C.MAX_CHUNK_LINES, keywords: dict | None = None, files: str | None = None
) -> str:
    return with_chunks(k, files) + f""",
    findings AS (SELECT *, {sql_heuristic('chunk', keywords or TEST_KEYWORDS)} AS category,
                        CAST(0 AS DOUBLE) AS confidence FROM chunks)"""


def with_records() -> str:
    return f"""
    records AS (SELECT doc_id, 'https://github.com/acme/web/pull/' || (doc_id // 3) || '/files' AS pr_url,
                       'acme/web/' || (doc_id // 3) AS review_key,
                       CASE WHEN (doc_id // 3) % 10 = 4 AND doc_id % 3 < 2 THEN 'twice.py'
                            ELSE source || '/' || doc_id || {SQL_EXTENSION} END AS filename,
                       CASE WHEN NOT (doc_id % 10 = 3 OR (doc_id // 3) % 50 = 7) THEN text END AS patch,
                       CAST(CASE WHEN doc_id % 7 > 0 THEN n_chars % 100 END AS INTEGER) AS additions,
                       CAST(CASE WHEN doc_id % 7 > 0 THEN n_chars % 7 END AS INTEGER) AS deletions
                FROM documents)"""


def with_examples() -> str:
    return """
    examples AS (SELECT text AS explanation,
                        CASE WHEN quality = 1 THEN 'APPROVE' ELSE 'REQUEST_CHANGES' END AS label,
                        text AS patch, source AS repo, d.doc_id AS pr_number
                 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def with_training(patterns: dict | None = None) -> str:
    return with_examples() + f""",
    training AS (SELECT left(patch, 2000) AS code,
                        {sql_weak_label('explanation', 'label', patterns or TEST_PATTERNS)} AS label,
                        label AS original_label, repo, pr_number FROM examples),
    keyed AS (SELECT *, {SQL_PREDICTED_KEY} AS key FROM training)"""


def with_done() -> str:
    return with_training() + """,
    done AS (SELECT key FROM keyed WHERE pr_number IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def with_labelled() -> str:
    texts = " ".join(f"WHEN {i} THEN {sql_lines(t)}" for i, t in enumerate(REPLY_TEXTS))
    label_of = f"lower(regexp_extract(response_text, '(?i)LABEL:[\\s]*({WORD}+)', 1))"
    confidence_of = f"lower(regexp_extract(response_text, '(?i)CONFIDENCE:[\\s]*({WORD}+)', 1))"
    known = "('" + "','".join(C.CATEGORIES) + "')"
    return with_done() + f""",
    replies AS (SELECT key, CASE length(code) % 6 {texts} END AS response_text,
                       CASE WHEN length(code) % 6 = 5 THEN 'timeout' END AS error,
                       CASE WHEN length(code) % 6 = 5 THEN pr_number % 5 ELSE 1 END AS attempts
                FROM keyed WHERE pr_number IN (SELECT doc_id FROM labels)),
    parsed AS (SELECT *, CASE WHEN {label_of} IN {known} THEN {label_of} END AS good_label,
                      CASE WHEN {confidence_of} = '' THEN 'unknown' ELSE {confidence_of} END AS good_confidence
               FROM replies),
    labelled AS (
        SELECT k.*, CASE WHEN response_text IS NOT NULL THEN coalesce(good_label, 'PARSE_FAILED')
                         WHEN attempts >= 3 THEN 'PARSE_FAILED' END AS judge_label,
               CASE WHEN good_label IS NOT NULL THEN good_confidence
                    WHEN response_text IS NOT NULL OR attempts >= 3 THEN 'none' END AS judge_confidence
        FROM keyed k LEFT JOIN parsed p ON k.key = p.key)"""


SQL_CHUNK_KEY = sql_key("review_key", "filename", "chunk_index", "chunk")


def with_commented() -> str:
    """Findings of five-line chunks with their comments."""
    return with_findings(5) + f""",
    comments AS (SELECT conv_id, turn,
                        CASE WHEN role = 'assistant' THEN ' ```py' || chr(10) || text || '```  use `it` ' || chr(10) END AS reply,
                        CASE WHEN role <> 'assistant' THEN 'asked by ' || role END AS error
                 FROM conversations),
    commented AS (SELECT f.*, coalesce(regexp_replace(reply, '^\\s+|\\s+$', '', 'g'),
                                       '(feedback unavailable: ' || coalesce(error, 'no reply') || ')') AS feedback
                  FROM findings f LEFT JOIN comments c ON c.conv_id = f.doc_id AND c.turn = f.chunk_index)"""


def with_probabilities() -> str:
    def total_of(k: int) -> str:
        """Entries k, k + 5, ... in their order."""
        return " + ".join(f"CAST(embedding[{i}] AS DOUBLE)" for i in range(k, 65, 5))

    powers = ", ".join(f"exp({total_of(i)}) AS e{i}" for i in range(1, 6))
    total = "(e1 + e2 + e3 + e4 + e5)"
    shares = ", ".join(f"e{i} / {total} AS p{i}" for i in range(1, 6))
    return f"""
    powers AS (SELECT vec_id, {powers} FROM embeddings),
    probabilities AS (SELECT vec_id, {shares} FROM powers)"""


SQL_CLASS_INDEX = "list_position(['bug','style','performance','security','ok'], label)"


def sql_fold(key: str, k: int = C.N_FOLDS) -> str:
    return (
        f"CAST((row_number() OVER (ORDER BY {SQL_CLASS_INDEX}, md5({key} || ':{C.FOLD_SEED}'), {key}) - 1)"
        f" % {k} + 1 AS INTEGER)"
    )


def with_predictions() -> str:
    return with_examples() + f""",
    pairs AS (SELECT CAST(pr_number AS VARCHAR) AS key,
                     {sql_weak_label('explanation', 'label', TEST_PATTERNS)} AS label,
                     {sql_heuristic('patch', TEST_KEYWORDS)} AS prediction FROM examples),
    predictions AS (SELECT *, {sql_fold('key')} AS fold FROM pairs),
    confusion AS (SELECT label, prediction, count(*) AS n FROM predictions GROUP BY ALL)"""
