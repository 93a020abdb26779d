import pytest
from pyspark.sql import functions as F

from acceptance import tables
from acceptance.catalog import CHECKS
from patchlight import constants as C
from patchlight import schemas
from patchlight.operators import filters, relabel as R
from patchlight.plans.training_set import build_training_set, sample_check, with_patch_rows, write_training_set
from patchlight.sources import run_store
from patchlight.sources.tables import read_labelled, write_labelled_run


def training(spark, rows):
    return spark.createDataFrame(rows, schemas.TRAINING_DATA)


def key_of(spark, rows):
    return [r.key for r in R.with_key(training(spark, rows)).collect()]


ROWS = [(f"code {i}", "bug", "REQUEST_CHANGES", "repo", i) for i in range(6)]


def replies(spark, rows):
    return spark.createDataFrame(rows, schemas.REPLIES)


def test_training_set(spark):
    examples = spark.createDataFrame(
        [("slow", "REQUEST_CHANGES", "p" * 3000, "r", 1), ("x", "APPROVE", "q", "r", 2), ("x", "APPROVE", None, "r", 3)],
        schemas.REVIEW_EXAMPLES,
    )
    got = build_training_set(examples).orderBy("pr_number").collect()
    assert [(len(r.code), r.label, r.original_label) for r in got] == [(2000, "performance", "REQUEST_CHANGES"), (1, "ok", "APPROVE")]
    assert [r.pr_number for r in with_patch_rows(examples)[1].collect()] == [3]


def test_sample_check_takes_the_first_row(spark):
    rows = training(spark, [("b2", "bug", "x", "r", 2), ("b1", "bug", "x", "s", 1), ("o", "ok", "x", "t", 9)])
    got = {r.category: (r.n, r.pr_number, r.repo, r.preview) for r in sample_check(rows, "pr_number").collect()}
    assert got == {"bug": (2, 1, "s", "b1..."), "ok": (1, 9, "t", "o...")}


def test_retry_rules(spark):
    keys = key_of(spark, ROWS)
    got = R.read_replies(
        R.with_key(training(spark, ROWS)),
        R.latest_replies(replies(spark, [
            (keys[0], "LABEL: ok\nCONFIDENCE: low", None, 1),
            (keys[1], "no idea", None, 1),
            (keys[2], None, "timeout", 2),
            (keys[3], None, "timeout", 3),
            (keys[4], None, "timeout", 2), (keys[4], "LABEL: style", None, 1),
        ])),
    )
    found = {r.pr_number: (r.judge_label, r.judge_confidence) for r in got.collect()}
    assert found == {
        0: ("ok", "low"), 1: ("PARSE_FAILED", "none"), 2: (None, None), 3: ("PARSE_FAILED", "none"),
        4: ("style", "unknown"), 5: (None, None),
    }


def test_runs_resume_and_a_finished_table_gains_nothing(spark, tmp_path):
    keys = key_of(spark, ROWS)
    data, path = training(spark, ROWS), str(tmp_path / "labelled")
    none_done = spark.createDataFrame([], "key string, judge_label string")
    assert R.prompts(data, none_done).count() == 6
    first = R.label_run(data, none_done, replies(spark, [(k, "LABEL: bug", None, 1) for k in keys[:4]]))
    write_labelled_run(first.select(*[c.split()[0] for c in schemas.LABELLED_DATA.split(", ")]), path, "1")
    done = read_labelled(spark, path)
    assert {r.key for r in R.prompts(data, done).collect()} == set(keys[4:])
    everything = replies(spark, [(k, "??", None, 1) for k in keys])
    second = R.label_run(data, done, everything)
    assert {(r.key, r.judge_label) for r in second.collect()} == {(k, "PARSE_FAILED") for k in keys[4:]}
    write_labelled_run(second.select(*done.drop("run_id").columns), path, "2")
    done = read_labelled(spark, path)
    assert done.count() == 6
    assert R.label_run(data, done, everything).count() == 0


def test_copies_share_one_prompt_and_one_label(spark):
    data = training(spark, ROWS[:1] * 50 + ROWS[1:2])
    none_done = spark.createDataFrame([], "key string, judge_label string")
    assert R.prompts(data, none_done).count() == 2
    key = key_of(spark, ROWS[:1])[0]
    got = R.label_run(data, none_done, replies(spark, [(key, "LABEL: bug", None, 1)]))
    assert got.count() == 50


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_split_in_the_reply_join(spark):
    """Two thirds of the rows share a key; adaptive execution splits their partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 30000, 1, 8).select(
            F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("key"),
            F.sha2(F.col("id").cast("string"), 256).alias("code"),
        )
        answers = spark.range(0, 30000, 1, 4).select(
            F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
            F.lit("LABEL: bug").alias("response_text"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"),
        )
        joined = R.attach_replies(rows, answers)
        got = joined.collect()
        assert len(got) == 30000 and all(r.response_text == "LABEL: bug" for r in got)
        assert "skew=true" in executed(joined)

        copies = rows.select(
            F.when(F.col("key") == "hot", "hot").otherwise(F.col("code")).alias("code"),
            F.lit("bug").alias("label"), F.lit("x").alias("original_label"), F.lit("r").alias("repo"),
            F.lit(1).cast("bigint").alias("pr_number"), F.col("code").alias("source_line"),
        )
        keys = R.with_key(copies).select("key").distinct()
        answers = keys.select(
            "key", F.lit("LABEL: bug").alias("response_text"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts")
        )
        done = spark.createDataFrame([], "key string, judge_label string")
        run = R.label_run(copies, done, answers)
        assert len(run.collect()) == 30000
        assert "skew=true" in executed(run)
    finally:
        for name in settings:
            spark.conf.unset(name)


def labelled(spark):
    rows = [
        ("a", "bug", "bug", "high"), ("b", "bug", "ok", "low"), ("c", "ok", "PARSE_FAILED", "none"),
        ("d", "ok", None, None), ("", "ok", "ok", "high"), (None, "ok", "feature", "high"),
    ]
    return spark.createDataFrame(rows, "code string, label string, judge_label string, judge_confidence string")


def test_filters(spark):
    rows = labelled(spark)
    codes = lambda df: [r.code for r in df.collect()]
    assert codes(filters.with_code(rows)) == ["a", "b", "c", "d"]
    assert codes(filters.trainable(rows)) == ["a", "b"]
    assert codes(filters.pending(rows)) == ["d"]
    assert codes(filters.parsed(rows)) == ["a", "b", "d", "", None]
    assert codes(filters.high_confidence(rows)) == ["a", "", None]
    empty = filters.unlabelled_columns(rows.select("code"))
    assert empty.where("judge_label IS NULL AND judge_confidence IS NULL").count() == 6


def test_audit(spark):
    got = {(r.metric, r.key): r.value for r in R.audit(labelled(spark)).collect()}
    assert got == {
        ("rows", ""): 6, ("valid", ""): 5, ("failed", ""): 1, ("done", ""): 5,
        ("label", "bug"): 1, ("label", "ok"): 2, ("label", "feature"): 1,
        ("confidence", "high"): 3, ("confidence", "low"): 1, ("agreement", ""): 40.0,
    }


def test_audit_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    labelled(spark).write.parquet(path)
    plan = R.audit(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_parse_failed_is_no_category():
    assert C.PARSE_FAILED not in C.CATEGORIES


def test_keys_keep_nulls_and_borders(spark):
    """Rows whose values only look alike when written one after another have keys of their own."""
    rows = [
        ("c", "bug", "x", None, 5), ("c", "bug", "x", "5", None), ("c", "bug", None, "x", 5), ("c", "bug", "", "x", 5),
        ("c", "bug", "y", "a\x01b", 1), ("b\x01c", "bug", "y", "a", 1), ("c", "bug", "y", "2:a", 1), ("c", "bug", "y", "-", 1),
    ]
    assert len(set(key_of(spark, rows))) == len(rows)
    done = spark.createDataFrame([], "key string, judge_label string")
    assert R.prompts(training(spark, rows), done).count() == len(rows)


def test_a_hot_key_is_split_before_the_labels_are_removed(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        key = F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("key")
        rows = spark.range(0, 30000, 1, 8).select(key, F.sha2(F.col("id").cast("string"), 256).alias("code"))
        done = spark.range(0, 30000, 1, 4).select(F.col("id").cast("string").alias("key"), F.lit("ok").alias("judge_label"))
        left = R.not_done(rows, done.where("id % 2 = 0"))
        assert {r.key for r in left.collect()} == {"hot", *(str(i) for i in range(2, 30000, 3) if i % 2)}
        assert "skew=true" in executed(left)
    finally:
        for name in settings:
            spark.conf.unset(name)


def decided(spark, **labels):
    return spark.createDataFrame([(k, v, "high") for k, v in labels.items()], run_store.DECISIONS)


def kept(spark, path):
    return {r.key: r.judge_label for r in run_store.decisions(spark, path).collect()}


def test_a_store_shows_finished_runs_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "it's a store")
    assert kept(spark, path) == {} and run_store.finished_runs(spark, path) == []
    run_store.add_run(decided(spark, a="bug", b=None), path, "1", buckets=3)
    before = run_store.decisions(spark, path)
    run_store.add_run(decided(spark, a="ok", c="ok"), path, "2")
    decided(spark, z="bug").write.parquet(f"{path}/runs/folder=99-unfinished")
    assert sorted(r.judge_label for r in run_store.decisions(spark, path).collect()) == ["bug", "ok", "ok"]
    run_store.add_run(decided(spark, a="style"), path, "1")
    assert [r.key for r in before.collect()] == ["a"]  # a reader goes on with what it has seen
    run_store.compact(spark, path)
    assert len(run_store.finished_runs(spark, path)) == 1 and run_store.bucket_count(spark, path) == 3
    assert kept(spark, path) == {"a": "style", "c": "ok"}  # of the run written last
    run_store.compact(spark, path)
    with pytest.raises(ValueError, match="compacted"):
        run_store.decisions(spark, path, apart_from="2")
    # A run that fails while it is written is not seen.
    monkeypatch.setattr(run_store, "FINISHED", "no such type")
    with pytest.raises(Exception, match="(?i)pars|type"):
        run_store._write(decided(spark, q="bug"), path, "3", [], 3, [])
    monkeypatch.undo()
    assert kept(spark, path) == {"a": "style", "c": "ok"}


def test_the_store_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "store")
    for run in range(3):
        run_store.add_run(decided(spark, **{f"k{run}{i}": "bug" for i in range(50)}), path, str(run), buckets=6)
    keys = spark.range(400).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = R.open_keys(keys, run_store.decisions(spark, path), run_store.bucket_count(spark, path))
        plan = executed(left)
        assert left.count() == 300  # k10 to k19, k110 to k149 and the same of 2 are done
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 6 out of 6" in plan
    assert plan.count("Exchange") == 2  # the distinct keys, and their dealing into buckets
    store = plan[plan.index("REPARTITION_BY_NUM") :]
    assert store.index("FileScan") > store.index("HashAggregate") and store[store.index("Range") :].count("Exchange") == 0


def test_counts_come_from_the_writing_pass(spark, tmp_path):
    keys = key_of(spark, ROWS)
    path, store = str(tmp_path / "labelled"), str(tmp_path / "store")
    data = training(spark, ROWS + ROWS[:1] + [("", "bug", "x", "r", 9)])
    first = replies(spark, [(keys[0], "LABEL: bug", None, 1), (keys[1], "??", None, 1), (keys[2], None, "timeout", 1)])
    for _ in range(2):
        counts = R.write_label_run(data, first, path, store, "1")
        assert counts == {"written": 3, "failed": 1, "agreed": 2, "pending": 4}
    assert read_labelled(spark, path).count() == 3
    rest = replies(spark, [(k, "LABEL: ok", None, 1) for k in keys])
    assert R.write_label_run(data, rest, path, store, "2") == {"written": 4, "failed": 0, "agreed": 0, "pending": 0}
    assert R.write_label_run(data, rest, path, store, "3") == {"written": 0, "failed": 0, "agreed": 0, "pending": 0}
    audit = {r.metric: r.value for r in R.audit(read_labelled(spark, path)).where("key = ''").collect()}
    assert (audit["rows"], audit["failed"], audit["done"]) == (7, 1, 7)


def test_training_set_is_counted_while_it_is_written(spark, tmp_path):
    examples = spark.createDataFrame(
        [("slow", "REQUEST_CHANGES", "p", "r", 1), ("x", "APPROVE", "q", "r", 2), ("x", "APPROVE", None, "r", 3)],
        schemas.REVIEW_EXAMPLES,
    )
    counts = write_training_set(examples, str(tmp_path / "set"))
    assert counts == {"examples": 3, "rejected": 1, "bug": 0, "style": 0, "performance": 1, "security": 0, "ok": 1}
    assert spark.read.parquet(str(tmp_path / "set")).count() == 2
    assert set(write_training_set(examples.limit(0), str(tmp_path / "none")).values()) == {0}


def test_the_queries_of_runs_deal_the_documents_out_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"hash {i} " + "x" * i, "en", "web", 9 + i) for i in range(24)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(12)], "doc_id bigint, quality int, toxic int")
    known.write.parquet(str(tmp_path / "labels.parquet"))
    read, whole = [], tables.documents
    monkeypatch.setattr(tables, "documents", lambda *given: read.append(given) or whole(*given))
    counts = {r.metric: r.n for r in CHECKS["label_run_counts"].query(spark, str(tmp_path)).collect()}
    kinds = [len(f"hash {i} " + "x" * i) % 6 for i in range(12)]
    written = [i for i in range(12) if i % 4 and (kinds[i] < 5 or i % 5 >= 3)]
    assert counts["written"] == len(written) and counts["written"] + counts["pending"] == 21
    assert len(read) == 1
    assert CHECKS["open_keys_of_runs"].query(spark, str(tmp_path)).count() == 21
    assert len(read) == 2
