"""Resumable relabelling: prompts out, judge replies in.

The judge itself runs outside Spark. Rows are matched by a key of their content, so
equal rows share one prompt and one label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patchlight import constants as C
from patchlight import schemas
from patchlight.functions.labels import judge_confidence, judge_label
from patchlight.functions.prompts import judge_prompt
from patchlight.functions.text import content_key, first_chars
from patchlight.operators.filters import with_code
from patchlight.sources import run_store
from patchlight.sources.tables import materialise, write_labelled_run

KEY_COLUMNS = ["repo", "pr_number", "original_label", "code"]


def with_key(training: DataFrame) -> DataFrame:
    return training.withColumn("key", content_key(*KEY_COLUMNS))


def not_done(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose key has no label yet; an unreadable reply counts as a label.

    A key that is done several times removes its rows as well as one that is done once, so the done keys
    are joined as they are: with a shuffle of their own on both sides, a hot key can be split.
    """
    labelled = done.where(F.col("judge_label").isNotNull()).select("key")
    return rows.join(labelled, "key", "left_anti")


def prompts(training: DataFrame, done: DataFrame) -> DataFrame:
    """``key, prompt`` for every distinct row still to label.

    The text is cut before it is moved, and copies collapse inside each task before the
    shuffle, so a row repeated many times makes no hot key in the join that follows.
    """
    snippets = (
        with_key(with_code(training))
        .select("key", first_chars(F.col("code"), C.MAX_JUDGE_CHARS).alias("snippet"))
        .groupBy("key")
        .agg(F.any_value("snippet").alias("snippet"))
    )
    return not_done(snippets, done).select("key", judge_prompt(F.col("snippet")).alias("prompt"))


def latest_replies(replies: DataFrame) -> DataFrame:
    """One reply per key: a text before an error, then the later attempt."""
    order = F.struct(F.col("response_text").isNotNull(), F.col("attempts"))
    return replies.groupBy("key").agg(
        F.max_by("response_text", order).alias("response_text"),
        F.max_by("error", order).alias("error"),
        F.max("attempts").alias("attempts"),
    )


def attach_replies(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Add the reply columns to each row by key; ``replies`` has one row per key.

    A key with many rows is hot on the left side only. Adaptive execution splits its
    partition as long as both sides are shuffled for this join, so pass a table here,
    not the result of another step on the same key.
    """
    return rows.join(replies, "key", "left")


def label_or_failed(reply: Column) -> Column:
    return F.coalesce(judge_label(reply), F.lit(C.PARSE_FAILED))


def confidence_or_none(reply: Column) -> Column:
    return F.coalesce(judge_confidence(reply), F.lit(C.NO_CONFIDENCE))


def read_replies(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Set judge_label and judge_confidence from the replies.

    A reply text decides at once. Without one the row stays pending until the last
    allowed attempt has failed.
    """
    reply = F.col("response_text")
    given_up = reply.isNull() & (F.col("attempts") >= C.MAX_ATTEMPTS)
    return (
        attach_replies(rows, replies)
        .withColumn(
            "judge_label",
            F.when(reply.isNotNull(), label_or_failed(reply)).when(given_up, C.PARSE_FAILED),
        )
        .withColumn(
            "judge_confidence",
            F.when(reply.isNotNull(), confidence_or_none(reply)).when(given_up, C.NO_CONFIDENCE),
        )
        .drop("response_text", "error", "attempts")
    )


def open_keys(rows: DataFrame, done: DataFrame, buckets: int | None = None) -> DataFrame:
    """The distinct keys of ``rows`` without a label; ``buckets`` is the number of buckets of ``done`` where it is a bucketed table.

    Copies collapse before the keys move. With ``buckets`` the keys are dealt as the table is, which then stays where it lies; the
    join keeps the other keys by their missing label, because the optimizer moves an anti join to before the dealing.
    """
    keys = rows.select("key").distinct()
    if not buckets:
        return not_done(keys, done)
    labelled = done.where(F.col("judge_label").isNotNull()).select("key", "judge_label")
    return keys.repartition(buckets, "key").join(labelled, "key", "left").where(F.col("judge_label").isNull()).select("key")


def label_run(training: DataFrame, done: DataFrame, replies: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows one run adds to the labelled table; none if nothing is pending.

    The labels are decided per distinct key, on short rows, and written; the join that
    brings them to the texts then starts from two tables (see ``attach_replies``).
    """
    rows = with_key(with_code(training))
    decided = read_replies(open_keys(rows, done, buckets), latest_replies(replies)).where(
        F.col("judge_label").isNotNull()
    )
    return rows.join(materialise(decided, "labels"), "key")


def write_label_run(training: DataFrame, replies: DataFrame, path: str, store: str, run_id: str) -> dict[str, int]:
    """Write the rows that one run adds, then its decisions; the counts come from the pass that writes the rows.

    ``path`` is the labelled table and ``store`` a store of finished runs (``run_store``), which says what is done. The answer counts the
    rows ``written``, the ``failed`` and ``agreed`` among them, and those still ``pending``. A run may be done again under the
    same ``run_id``, after a failure for one, and replaces what it had written.
    """
    spark = training.sparkSession
    earlier = run_store.decisions(spark, store, apart_from=run_id)
    rows = with_key(with_code(training))
    found = read_replies(open_keys(rows, earlier, run_store.bucket_count(spark, store)), latest_replies(replies))
    decided = materialise(found, "labels")
    label, counts = F.col("judge_label"), Observation()
    observed = rows.join(decided, "key").observe(
        counts,
        F.count_if(label.isNotNull()).alias("written"),
        F.count_if(label == C.PARSE_FAILED).alias("failed"),
        F.count_if(label == F.col("label")).alias("agreed"),
        F.count_if(label.isNull()).alias("pending"),
    )
    columns = [f.name for f in StructType.fromDDL(schemas.LABELLED_DATA)]
    write_labelled_run(observed.where(label.isNotNull()).select(columns), path, run_id)
    run_store.add_run(decided, store, run_id)
    return counts.get


def audit(rows: DataFrame) -> DataFrame:
    """``metric, key, value`` over a labelled table: counts, distributions, agreement.

    One pass counts the combinations of the three short columns; everything else is
    summed from that small table.
    """
    n, label = F.col("n"), F.col("judge_label")
    failed = label.eqNullSafe(C.PARSE_FAILED)
    agrees = F.coalesce(label == F.col("label"), F.lit(False))

    def entry(when: Column, metric: str, key: Column, part: Column) -> Column:
        return F.when(
            when,
            F.struct(F.lit(metric).alias("metric"), key.alias("key"), part.alias("part"), n.alias("whole")),
        )

    blank, always = F.lit(""), F.lit(True)
    entries = F.array(
        entry(always, "rows", blank, n),
        entry(always, "valid", blank, F.when(~failed, n).otherwise(0)),
        entry(always, "failed", blank, F.when(failed, n).otherwise(0)),
        entry(always, "done", blank, F.when(label.isNotNull(), n).otherwise(0)),
        entry(~failed & label.isNotNull(), "label", label, n),
        entry(
            ~failed & F.col("judge_confidence").isNotNull(),
            "confidence",
            F.col("judge_confidence"),
            n,
        ),
        entry(~failed, "agreement", blank, F.when(agrees, n).otherwise(0)),
    )
    combinations = rows.groupBy("label", "judge_label", "judge_confidence").agg(
        F.count(F.lit(1)).alias("n")
    )
    share = F.col("metric") == "agreement"
    return (
        combinations.select(F.inline(F.filter(entries, lambda e: e.isNotNull())))
        .groupBy("metric", "key")
        .agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"))
        .select(
            "metric",
            "key",
            F.when(share, 100 * F.col("part") / F.col("whole")).otherwise(F.col("part")).alias("value"),
        )
    )
