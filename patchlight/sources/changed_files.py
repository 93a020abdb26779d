"""Changed files from landed review records and from pasted code.

Both give the same table: ``review_key, filename, language, patch, additions,
deletions``. Names may repeat within a review; ``file_id``, where the records have it, tells the files apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight import schemas
from patchlight.functions.naming import language, pr_number, pr_owner, pr_repo
from patchlight.functions.text import has_content, line_count
from patchlight.operators.columns import with_columns_once

COLUMNS = ["review_key", "filename", "language", "patch", "additions", "deletions"]
# Where and when a record landed, carried along where the records have it.
LANDING = ["landing"]
IDENTITY = ["file_id", *LANDING]
ENTRY_FIELDS = {"filename": "string", "patch": "string", "additions": "int", "deletions": "int"}


def read_pr_files(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Landed records, one changed file per row."""
    return spark.read.format(format).schema(schemas.PR_FILES).load(path)


def split_pr_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of landed JSON lines, and ``pr_url, line, reason`` of the lines that are no record."""
    # Parsed as a whole, not by the columns that are used: else a line with a wrong count would be a record for some.
    options = {"columnNameOfCorruptRecord": "_line"}
    lines = spark.read.text(path).where(has_content(F.col("value")))
    record = F.from_json("value", f"{schemas.PR_FILES}, _line string", options)
    read = lines.select(F.inline(F.array(record)))
    unreadable = F.col("_line").isNotNull()
    rejects = read.where(unreadable).select("pr_url", F.col("_line").alias("line"), F.lit("not a record").alias("reason"))
    return read.where(~unreadable).drop("_line"), rejects


def read_pr_bodies(spark: SparkSession, path: str, format: str = "json") -> tuple[DataFrame, DataFrame]:
    """Records and rejects of landed replies of the code host, one JSON array of changed files per row."""
    return split_bodies(spark.read.format(format).schema(schemas.PR_BODIES).load(path))


def split_bodies(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changed files of all replies, and ``pr_url, entry, reason`` of what cannot be read.

    A reply is read entry by entry, so an odd entry is a reject of its own (``entry`` is its place) and costs none of its
    neighbours; ``entry`` is NULL where the whole reply is unreadable or empty. Each entry is a record or a reject.
    A missing or null field is no fault. ``file_id`` names the place where a record landed; a
    column ``landing`` is carried along and is part of it.
    """
    landing = [c for c in LANDING if c in bodies.columns]
    body = {
        "value": F.try_parse_json("body"),
        "missing": F.col("body").isNull(),
        "start": F.substring(F.ltrim("body"), 1, 1),
    }
    entries = F.posexplode_outer(F.try_variant_get("value", "$", "array<variant>")).alias("entry", "item")
    read = with_columns_once(bodies.select(*landing, "pr_url", "body"), body).select(
        *landing, "pr_url", "missing", F.col("value").isNull().alias("unread"), "start", entries
    )
    whole = (
        F.when(F.col("missing"), "no body")
        .when(F.col("unread"), "not json")
        .when(F.col("start") == "{", "error object")
        .when(F.col("start") != "[", "not a list")
        .otherwise("empty list")
    )
    fields = {name: F.try_variant_get("item", f"$.{name}", kind) for name, kind in ENTRY_FIELDS.items()}
    values = {**fields, "reason": F.when(F.col("entry").isNull(), whole).otherwise(_entry_problem())}
    split = with_columns_once(read.select(*landing, "pr_url", "missing", "unread", "start", "entry", "item"), values)
    place = F.concat_ws("#", *landing, "pr_url", F.col("entry").cast("string")).alias("file_id")
    records = split.where(F.col("reason").isNull()).select(*landing, place, "pr_url", *ENTRY_FIELDS)
    return records, split.where(F.col("reason").isNotNull()).select(*landing, "pr_url", "entry", "reason")


def _entry_problem() -> Column:
    """Why an entry is no changed file, NULL if it is one."""
    kind = F.schema_of_variant("item")
    problem = F.when(kind == "VOID", "null entry").when(~kind.startswith("OBJECT"), "not an object")
    for name, wanted in ENTRY_FIELDS.items():
        given = F.try_variant_get("item", f"$.{name}", "variant")
        there = given.isNotNull() & ~F.is_variant_null(given)
        if wanted == "string":
            problem = problem.when(there & (F.schema_of_variant(given) != "STRING"), f"{name} is not text")
        else:
            wrong = F.try_variant_get("item", f"$.{name}", wanted).isNull()
            problem = problem.when(there & wrong, f"{name} is not a number")
    return problem


def records_of_bodies(bodies: DataFrame) -> DataFrame:
    """One row per changed file of the replies; ``split_bodies`` has what is unreadable."""
    return split_bodies(bodies)[0]


def latest_landing(rows: DataFrame, *review: str, landing: str = "landing") -> DataFrame:
    """The rows of the last landing of each review: what landed before is no longer part of it.

    A review is fetched as a whole, so a file that its last landing lacks is gone. Landings are compared as
    they sort; a missing one is older than all others. Two narrow columns are aggregated, and the join with them
    can be split where one review has most of the rows. ``rows`` is read twice.
    """
    keys = list(review) or ["review_key"]
    at = F.coalesce(F.col(landing).cast("string"), F.lit(""))
    last = rows.groupBy(*keys).agg(F.max(at).alias("_landing"))
    return rows.withColumn("_landing", at).join(last, [*keys, "_landing"], "left_semi").drop("_landing")


def parse_pr_urls(rows: DataFrame, url: str = "pr_url") -> DataFrame:
    """Add owner, repo and pr_number; all three are NULL where the address is no review."""
    number = pr_number(F.col(url))
    return (
        rows.withColumn("pr_number", number)
        .withColumn("owner", F.when(F.col("pr_number").isNotNull(), pr_owner(F.col(url))))
        .withColumn("repo", F.when(F.col("pr_number").isNotNull(), pr_repo(F.col(url))))
    )


def invalid_pr_urls(rows: DataFrame, url: str = "pr_url") -> DataFrame:
    return (
        parse_pr_urls(rows, url)
        .where(F.col("pr_number").isNull())
        .select(F.col(url).alias("pr_url"), F.lit("invalid pull request address").alias("reason"))
    )


def from_pr_files(records: DataFrame) -> DataFrame:
    """Review records with a valid address, missing counts as 0; ``file_id`` and ``landing`` are kept."""
    return (
        parse_pr_urls(records)
        .where(F.col("pr_number").isNotNull())
        .select(
            *[c for c in IDENTITY if c in records.columns],
            F.concat_ws("/", "owner", "repo", F.col("pr_number").cast("string")).alias("review_key"),
            F.coalesce("filename", F.lit("")).alias("filename"),
            language(F.coalesce("filename", F.lit(""))).alias("language"),
            "patch",
            F.coalesce("additions", F.lit(0)).alias("additions"),
            F.coalesce("deletions", F.lit(0)).alias("deletions"),
        )
    )


def from_raw_code(raw: DataFrame) -> DataFrame:
    """Pasted code; additions is its number of lines, the language is not guessed."""
    return raw.select(
        "review_key",
        F.coalesce("filename", F.lit(C.PASTED_CODE)).alias("filename"),
        F.lit(C.UNKNOWN_LANGUAGE).alias("language"),
        F.col("code").alias("patch"),
        line_count(F.col("code")).cast("int").alias("additions"),
        F.lit(0).alias("deletions"),
    )


def with_patch(files: DataFrame) -> DataFrame:
    """Only files that have a patch; NULL (binary, pure rename) drops as well."""
    return files.where(F.col("patch") != "")


def split_blank_code(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable pasted code, and the blank rest with the reason of its rejection."""
    usable = F.coalesce(has_content(F.col("code")), F.lit(False))
    return raw.where(usable), raw.where(~usable).withColumn("reason", F.lit("code is empty"))


def without_reviewable_file(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested reviews none of whose files has a patch."""
    return (
        requested.select("review_key")
        .distinct()
        .join(with_patch(files).select("review_key").distinct(), "review_key", "left_anti")
        .withColumn("reason", F.lit("no reviewable code changes"))
    )


def all_inputs(*inputs: DataFrame) -> DataFrame:
    """Files of several sources in one table."""
    first, *rest = [i.select(*COLUMNS) for i in inputs]
    for other in rest:
        first = first.unionByName(other)
    return first
