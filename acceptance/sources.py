"""Sources, sinks, input checks and chunking."""

from pyspark.sql import functions as F

from acceptance import tables as T
from acceptance.registry import check
from patchlight import constants as C
from patchlight import schemas
from patchlight.functions.naming import language
from patchlight.operators.chunks import explode_chunks
from patchlight.session import work_dir
from patchlight.sources import changed_files as S
from patchlight.sources.code_files import code_text, read_code_files
from patchlight.sources.tables import (
    read_csv,
    read_labelled,
    read_review_examples,
    write_labelled_run,
    write_table,
)

RECORD_FILES = f"""
    SELECT review_key, filename, {T.SQL_LANGUAGE} AS language, patch,
           coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions FROM records"""


@check("S1", f"WITH {T.with_records()} {RECORD_FILES}")
def landed_review_files(spark, sf):
    path = work_dir(spark, "records")
    T.pr_records(spark, sf).write.json(path)
    return S.from_pr_files(S.read_pr_files(spark, path))


@check("S1", f"WITH {T.with_records()} {RECORD_FILES}")
def landed_review_bodies(spark, sf):
    """A reply holds the files of one review, here three."""
    file = F.struct("filename", "patch", "additions", "deletions")
    bodies = T.pr_records(spark, sf).groupBy("pr_url").agg(
        F.to_json(F.collect_list(file)).alias("body")
    )
    return S.from_pr_files(S.records_of_bodies(bodies)).drop("file_id")


@check(
    "S1",
    """SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'no body' WHEN 2 THEN 'not json' WHEN 3 THEN 'error object'
                       WHEN 4 THEN 'empty list' END AS reason FROM pages WHERE page_id % 5 > 0""",
)
def rejected_review_bodies(spark, sf):
    """Of five pages one is a readable reply; the others are missing, web pages, errors or empty."""
    kind = F.col("page_id") % 5
    entry = F.to_json(F.array(F.struct(F.col("url").alias("filename"), F.col("html").alias("patch"))))
    body = (
        F.when(kind == 0, entry)
        .when(kind == 2, F.concat(F.lit("<"), F.col("html")))
        .when(kind == 3, F.to_json(F.struct(F.col("html").alias("message"))))
        .when(kind == 4, "[]")
    )
    bodies = T.pages(spark, sf).select(F.col("page_id").cast("string").alias("pr_url"), body.alias("body"))
    rejects = S.split_bodies(bodies)[1]
    return rejects.select(F.col("pr_url").cast("bigint").alias("page_id"), "reason")


# Of nine entries of a reply four are odd: a number, null, a list, a file whose name is a number.
ODD = {3: "not an object", 5: "null entry", 6: "not an object", 8: "filename is not text"}


@check(
    "S1",
    f"""WITH {T.with_records()}
        SELECT CAST(pr_url AS VARCHAR) AS pr_url,
               CASE WHEN doc_id % 9 NOT IN (3, 5, 6, 8) THEN filename END AS filename,
               CASE WHEN doc_id % 9 NOT IN (3, 5, 6, 8) THEN length(patch) END AS n,
               CASE WHEN doc_id % 9 NOT IN (3, 5, 6, 8) THEN additions END AS additions,
               CASE doc_id % 9 {' '.join(f"WHEN {k} THEN '{reason}'" for k, reason in ODD.items())} END AS reason
        FROM records""",
)
def mixed_review_bodies(spark, sf):
    """Replies in which odd entries stand next to files: an entry is a record or a reject, and none is lost."""
    rows = T.pr_records(spark, sf, F.col("doc_id"))
    kind = F.col("doc_id") % 9
    good = F.to_json(F.struct("filename", "patch", "additions", "deletions"))
    entry = (
        F.when(kind == 3, F.col("doc_id").cast("string"))
        .when(kind == 5, "null")
        .when(kind == 6, F.to_json(F.array("filename")))
        .when(kind == 8, F.to_json(F.struct(F.col("doc_id").alias("filename"), "patch")))
        .otherwise(good)
    )
    # A review has three documents, so a reply has three entries.
    replies = rows.groupBy("pr_url").agg(F.concat(F.lit("["), F.concat_ws(", ", F.collect_list(entry)), F.lit("]")).alias("body"))
    records, rejects = S.split_bodies(replies)
    read = records.select("pr_url", "filename", F.length("patch").cast("bigint").alias("n"), "additions")
    return read.unionByName(rejects.select("pr_url", "reason"), allowMissingColumns=True)


@check("S2", "SELECT doc_id, text AS code FROM documents")
def code_files_read(spark, sf):
    """All documents written as text files, a separator after each, and read as files of code."""
    path = work_dir(spark, "code")
    marked = F.concat_ws("\x02", F.col("doc_id").cast("string"), "text")
    T.documents(spark, sf).select(marked.alias("value")).write.option("lineSep", "\x01").text(path)
    rows = read_code_files(spark, path, "*.txt").select(F.explode(F.split("code", "\x01")).alias("r")).where("r <> ''")
    parts = F.split("r", "\x02")
    return rows.select(parts[0].cast("bigint").alias("doc_id"), parts[1].alias("code"))


@check("S2", "SELECT doc_id, text AS code FROM documents")
def code_files_decoded(spark, sf):
    """Document bytes with stray bytes before, and half a character after the text."""
    broken = F.concat(
        F.unhex(F.lit("FF80")), F.encode(F.col("text"), "UTF-8"), F.unhex(F.lit("E282"))
    )
    return T.documents(spark, sf).select("doc_id", code_text(broken).alias("code"))


def _raw(spark, sf):
    return T.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("review_key"),
        F.col("text").alias("code"),
        F.when(F.col("lang") != "en", F.concat(F.col("lang"), F.lit(".py"))).alias("filename"),
    )


@check(
    "S3",
    """SELECT CAST(doc_id AS VARCHAR) AS review_key,
              CASE WHEN lang <> 'en' THEN lang || '.py' ELSE 'pasted_code' END AS filename,
              'Unknown' AS language, text AS patch,
              CAST(length(text) - length(replace(text, chr(10), '')) +
                   CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS INTEGER) AS additions,
              CAST(0 AS INTEGER) AS deletions FROM documents""",
)
def pasted_code_files(spark, sf):
    return S.from_raw_code(_raw(spark, sf))


@check(
    "S4",
    f"""WITH {T.with_examples()}
        SELECT repo, pr_number, label, explanation, length(patch) AS patch_chars FROM examples""",
)
def review_examples_source(spark, sf):
    path = work_dir(spark, "examples")
    write_table(T.examples(spark, sf), path)
    return read_review_examples(spark, path).select(
        "repo", "pr_number", "label", "explanation", F.length("patch").cast("bigint").alias("patch_chars")
    )


@check(
    "S5 S6",
    f"WITH {T.with_training()} SELECT code, label, original_label, repo, pr_number FROM training",
)
def training_csv_round_trip(spark, sf):
    path = work_dir(spark, "csv")
    write_table(T.training(spark, sf), path, "csv")
    return read_csv(spark, path, schemas.TRAINING_DATA)


@check(
    "S6",
    f"WITH {T.with_training()} SELECT code, label, original_label, repo, pr_number FROM training",
)
def training_parquet_round_trip(spark, sf):
    path = work_dir(spark, "training")
    write_table(T.training(spark, sf), path)
    return spark.read.schema(schemas.TRAINING_DATA).parquet(path)


@check(
    "S7",
    f"""WITH {T.with_labelled()}
        SELECT key, repo, pr_number, judge_label, judge_confidence FROM labelled
        WHERE judge_label IS NOT NULL""",
)
def labelled_runs(spark, sf):
    """A run written twice counts once."""
    path = work_dir(spark, "labelled")
    rows = T.labelled(spark, sf).where(F.col("judge_label").isNotNull())
    write_labelled_run(rows.where("judge_label <> 'PARSE_FAILED'"), path, "first")
    for _ in range(2):
        write_labelled_run(rows.where("judge_label = 'PARSE_FAILED'"), path, "second")
    return read_labelled(spark, path).select(
        "key", "repo", "pr_number", "judge_label", "judge_confidence"
    )


@check(
    "P1",
    f"WITH {T.with_records()} SELECT review_key, filename, length(patch) AS n FROM records WHERE patch <> ''",
)
def files_with_patch(spark, sf):
    return S.with_patch(S.from_pr_files(T.pr_records(spark, sf))).select(
        "review_key", "filename", F.length("patch").cast("bigint").alias("n")
    )


@check(
    "P2",
    f"""WITH {T.with_records()}
        SELECT review_key, 'no reviewable code changes' AS reason FROM records
        GROUP BY review_key HAVING count(patch) = 0""",
)
def reviews_without_code(spark, sf):
    files = S.from_pr_files(T.pr_records(spark, sf))
    return S.without_reviewable_file(files, files)


def _partly_blank(spark, sf):
    """Documents as pasted code; of one in ten only the white space is left."""
    code = F.when(F.col("doc_id") % 10 == 3, F.regexp_replace("text", r"\S", "")).otherwise(F.col("text"))
    return T.documents(spark, sf).select("doc_id", code.alias("code"))


@check(
    "P3",
    r"""WITH raw AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN regexp_replace(text, '\S', '', 'g') ELSE text END AS code
                     FROM documents)
        SELECT doc_id, CASE WHEN regexp_matches(code, '\S') THEN 'usable' ELSE 'code is empty' END AS outcome FROM raw""",
)
def blank_code(spark, sf):
    usable, blank = S.split_blank_code(_partly_blank(spark, sf))
    return usable.select("doc_id", F.lit("usable").alias("outcome")).unionByName(
        blank.select("doc_id", F.col("reason").alias("outcome"))
    )


CHUNK_COLUMNS = "review_key, filename, chunk_index, chunk"


@check("G1", f"WITH {T.with_chunks()} SELECT {CHUNK_COLUMNS} FROM chunks")
def diff_chunks(spark, sf):
    return T.chunks(spark, sf).select("review_key", "filename", "chunk_index", "chunk")


@check("G1", f"WITH {T.with_chunks(5)} SELECT {CHUNK_COLUMNS} FROM chunks")
def diff_chunks_of_five(spark, sf):
    return T.chunks(spark, sf, 5).select("review_key", "filename", "chunk_index", "chunk")


@check(
    "G2",
    f"WITH {T.with_chunks()} SELECT CAST(doc_id AS VARCHAR) AS review_key, chunk_index, chunk FROM chunks",
)
def pasted_code_chunks(spark, sf):
    return explode_chunks(S.from_raw_code(_raw(spark, sf))).select("review_key", "chunk_index", "chunk")


@check(
    "P14",
    f"""WITH {T.with_chunks()}
        SELECT review_key, filename, language, additions, deletions, chunk_index FROM chunks""",
)
def chunk_columns(spark, sf):
    return T.chunks(spark, sf).select(
        "review_key", "filename", "language", "additions", "deletions", "chunk_index"
    )


PAGE_URLS = """
    urls AS (SELECT page_id,
                CASE WHEN url LIKE 'https:%'
                     THEN 'https://github.com/' || regexp_extract(url, '//([^/]+)/([^/]+)/', 1) || '/' ||
                          regexp_extract(url, '//([^/]+)/([^/]+)/', 2) || '/pull/' || page_id
                     ELSE url END AS pr_url FROM pages),
    parts AS (SELECT *, string_split(pr_url, '/') AS p,
                     pr_url LIKE 'https:%' AND len(string_split(pr_url, '/')) = 7
                       AND string_split(pr_url, '/')[4] <> '' AND string_split(pr_url, '/')[5] <> '' AS good
              FROM urls)"""


@check(
    "F1",
    f"""WITH {PAGE_URLS}
        SELECT page_id, CASE WHEN good THEN p[4] END AS owner, CASE WHEN good THEN p[5] END AS repo,
               CASE WHEN good THEN page_id END AS pr_number FROM parts""",
)
def review_addresses(spark, sf):
    return S.parse_pr_urls(T.page_urls(spark, sf)).select("page_id", "owner", "repo", "pr_number")


@check(
    "F1",
    f"""WITH {PAGE_URLS}
        SELECT pr_url, 'invalid pull request address' AS reason FROM parts WHERE NOT good""",
)
def invalid_review_addresses(spark, sf):
    return S.invalid_pr_urls(T.page_urls(spark, sf))


@check("F2", f"WITH {T.with_files()} SELECT filename, language FROM files")
def file_languages(spark, sf):
    return T.documents(spark, sf).select(
        T.filename().alias("filename"), language(T.filename()).alias("language")
    )


@check(
    "U1",
    f"""WITH {T.with_records()}, both_inputs AS ({RECORD_FILES} WHERE patch <> ''
            UNION ALL SELECT CAST(doc_id AS VARCHAR), 'pasted_code', 'Unknown', text,
                CAST(length(text) - length(replace(text, chr(10), '')) +
                     CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS INTEGER), 0
            FROM documents)
        SELECT review_key, filename, language, length(patch) AS n, additions, deletions FROM both_inputs""",
)
def all_inputs(spark, sf):
    raw = _raw(spark, sf).withColumn("filename", F.lit(None).cast("string"))
    both = S.all_inputs(
        S.with_patch(S.from_pr_files(T.pr_records(spark, sf))), S.from_raw_code(raw)
    )
    return both.withColumn("n", F.length("patch").cast("bigint")).drop("patch")
