import json
import random

import pytest
from pyspark.sql import functions as F

from acceptance.catalog import CHECKS
from patchlight import constants as C
from patchlight import schemas
from patchlight.operators import filters, rollups
from patchlight.operators import findings as FI
from patchlight.plans.review import by_keywords, find, respond, review
from patchlight.sources import changed_files as S
from patchlight.sources.code_files import read_code_files
from patchlight.session import work_dir
from patchlight.sources.tables import materialise, read_csv, read_findings, with_row_id, write_table
from patchlight.streaming import continuous_review as stream

URL = "https://github.com/o/r/pull/"


def records(spark):
    return spark.createDataFrame(
        [
            (URL + "1", "a.py", "null\n" * 31, 3, None),
            (URL + "1", None, "x", None, 1),
            (URL + "2", "b.go", "", 1, 1),
            (URL + "2", "c.go", None, 1, 1),
            ("https://gitlab.com/o/r/pull/1", "d.py", "x", 1, 1),
        ],
        schemas.PR_FILES,
    )


def test_changed_files_from_records(spark):
    files = S.from_pr_files(records(spark))
    got = {(r.review_key, r.filename, r.language, r.additions, r.deletions) for r in files.collect()}
    assert got == {
        ("o/r/1", "a.py", "Python", 3, 0), ("o/r/1", "", "Unknown", 0, 1),
        ("o/r/2", "b.go", "Go", 1, 1), ("o/r/2", "c.go", "Go", 1, 1),
    }
    assert {r.filename for r in S.with_patch(files).collect()} == {"a.py", ""}
    requested = spark.createDataFrame([("o/r/1",), ("o/r/2",), ("o/r/2",), ("o/r/3",)], "review_key string")
    rejects = S.without_reviewable_file(requested, files)
    assert sorted(r.review_key for r in rejects.collect()) == ["o/r/2", "o/r/3"]


def test_the_patch_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "files")
    S.from_pr_files(records(spark)).write.parquet(path)
    plan = find(spark.read.parquet(path)).select("filename", "category")._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(patch,))" in plan
    assert "additions" not in plan.split("ReadSchema")[1]
    assert "Exchange" not in plan


def test_records_from_bodies_and_json(spark, tmp_path):
    body = json.dumps([{"filename": "a.py", "patch": "x", "additions": 2, "sha": "0"}, {"filename": "b"}])
    others = ["not json", None, '{"message": "Not Found"}', "[]", '"text"', '[{"filename": "cut']
    bodies = spark.createDataFrame([(URL + "1", body), *[(f"{URL}{i}", b) for i, b in enumerate(others, 2)]], schemas.PR_BODIES)
    records, rejects = S.split_bodies(bodies)
    got = [tuple(r) for r in records.collect()]
    assert got == [(f"{URL}1#0", URL + "1", "a.py", "x", 2, None), (f"{URL}1#1", URL + "1", "b", None, None, None)]
    assert {r.pr_url[len(URL) :]: r.reason for r in rejects.collect()} == {
        "2": "not json", "3": "no body", "4": "error object", "5": "empty list", "6": "not a list", "7": "not json"}
    path = str(tmp_path / "bodies")
    bodies.limit(1).write.json(path)
    records, rejects = S.read_pr_bodies(spark, path)
    assert (records.count(), rejects.count()) == (2, 0)


def test_an_odd_entry_costs_no_other(spark):
    entries = {
        '{"filename": "a.py", "patch": "x"}': None, "3": "not an object", "null": "null entry", '"x"': "not an object",
        '["a"]': "not an object", '{"filename": 7}': "filename is not text", '{"patch": {}}': "patch is not text",
        '{"additions": [1]}': "additions is not a number", '{"deletions": 3000000000}': "deletions is not a number",
        '{"filename": null, "additions": null}': None, "{}": None, '{"filename": "b.py", "additions": 4, "deletions": 1}': None}
    whole = f"[{', '.join(entries)}]"
    bodies = [(URL + "1", whole), (URL + "2", "[1]"), (URL + "3", "[null]"), (URL + "4", '[["a"]]'), (URL + "5", " [ ] ")]
    records, rejects = S.split_bodies(spark.createDataFrame(bodies, schemas.PR_BODIES))
    good = {r.file_id: (r.filename, r.patch, r.additions, r.deletions) for r in records.collect()}
    reasons = {(r.pr_url[-1], r.entry): r.reason for r in rejects.collect()}
    assert reasons == {("1", i): reason for i, reason in enumerate(entries.values()) if reason} | {
        ("2", 0): "not an object", ("3", 0): "null entry", ("4", 0): "not an object", ("5", None): "empty list"}
    assert good == {f"{URL}1#0": ("a.py", "x", None, None), f"{URL}1#9": (None,) * 4, f"{URL}1#10": (None,) * 4,
                    f"{URL}1#11": ("b.py", None, 4, 1)}
    assert records.count() + sum(k[1] is not None for k in reasons) == len(entries) + 3


def test_lines_that_are_no_record(spark, tmp_path):
    path = tmp_path / "lines"
    path.mkdir()
    (path / "a.json").write_text(json.dumps({"pr_url": URL + "1", "filename": "a"}) + '\nnot json\n{"pr_url": "u", "additions": "x"}\n')
    records, rejects = S.split_pr_lines(spark, str(path))
    assert [(r.pr_url, r.filename) for r in records.collect()] == [(URL + "1", "a")]
    assert {(r.pr_url, r.reason) for r in rejects.collect()} == {(None, "not a record"), ("u", "not a record")}


def test_the_last_landing_of_a_review_counts(spark):
    rows = [(URL + "1", f, p, 1, 1, day) for day, f, p in [("1", "a.py", "null"), ("1", "gone.py", "slow"), ("2", "a.py", "x")]]
    rows += [(URL + "2", "b.py", "null", 1, 1, "1"), (URL + "3/files", "c.py", "x", 1, 1, None), (URL + "3", "c.py", "null", 1, 1, "0")]
    landed = spark.createDataFrame(rows, f"{schemas.PR_FILES}, landing string")
    _, totals = by_review(respond(landed))
    assert {k: (t.n_files, t.total_issues) for k, t in totals.items()} == {"o/r/1": (1, 0), "o/r/2": (1, 1), "o/r/3": (1, 1)}


def test_response_with_a_label_and_comments(spark):
    """Files of one name keep their own chunks, labels and comments."""
    rows = [("1", URL + "1", "a.py", "one\ntwo", 1, 0), ("2", URL + "1", "a.py", "three", 2, 0), ("3", URL + "1", "a.png", None, 0, 0)]
    landed = spark.createDataFrame(rows, f"file_id string, {schemas.PR_FILES}")

    def label(chunks):
        return chunks.withColumn("category", F.when(F.col("chunk") == "two", "bug").otherwise("ok")).withColumn("confidence", F.lit(0.75))

    keyed = FI.with_chunk_key(find(S.from_pr_files(landed), max_lines=1)).where("chunk <> 'one'")
    replies = keyed.select(F.col("chunk_key").alias("key"), F.concat(F.lit("about "), "chunk").alias("response_text"),
                           F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"))
    for given in (landed, landed.drop("file_id")):
        files, totals = by_review(respond(given, replies, label, 1))
        found = {f.additions: [(c.chunk, c.category, c.confidence, c.feedback) for c in f.findings] for f in files["o/r/1"]}
        assert found == {1: [("one", "ok", 0.75, "(feedback unavailable: no reply)"), ("two", "bug", 0.75, "about two")],
                         2: [("three", "ok", 0.75, "about three")]}
        assert (totals["o/r/1"].n_files, totals["o/r/1"].total_issues) == (2, 1)
    with pytest.raises(ValueError, match="identify a file"):
        rollups.nest_findings(S.from_pr_files(landed.drop("file_id")), find(S.from_pr_files(landed.drop("file_id"))))


def test_raw_code(spark):
    raw = spark.createDataFrame([("k", "a\nb\n", None), ("l", "c", "x.py"), ("m", " \n\t", None), ("n", None, None)], schemas.RAW_CODE)
    usable, blank = S.split_blank_code(raw)
    assert sorted(r.review_key for r in blank.collect()) == ["m", "n"]
    got = [tuple(r) for r in S.from_raw_code(usable).collect()]
    assert got == [("k", "pasted_code", "Unknown", "a\nb\n", 2, 0), ("l", "x.py", "Unknown", "c", 1, 0)]
    assert S.all_inputs(S.from_pr_files(records(spark)), S.from_raw_code(usable)).count() == 6


def test_code_files(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 1\r\n\xff# caf\xc3\xa9")
    (tmp_path / "b.txt").write_bytes(b"no")
    got = read_code_files(spark, str(tmp_path), "*.py").collect()
    assert [r.code for r in got] == ["x = 1\n# café"] and got[0].filename.endswith("a.py")


def test_csv_cells(spark, tmp_path):
    rows = spark.createDataFrame(
        [('a,"q"\nb', "bug", " x ", "r", 1), ("NA", "null", "None", "", 2), ("\\n", "ok", "a\\", "r", None)], schemas.TRAINING_DATA
    )
    path = str(tmp_path / "csv")
    write_table(rows, path, "csv")
    got = sorted((tuple(r) for r in read_csv(spark, path, schemas.TRAINING_DATA).collect()), key=repr)
    assert got == sorted(
        [('a,"q"\nb', "bug", " x ", "r", 1), (None, None, None, None, 2), ("\\n", "ok", "a\\", "r", None)], key=repr
    )


def test_review_with_comments(spark):
    files = S.from_pr_files(records(spark))
    found = find(files)
    keys = {(r.filename, r.chunk_index): r.chunk_key for r in FI.with_chunk_key(found).collect()}
    prompts = {r.key: r.prompt for r in FI.feedback_prompts(found).collect()}
    assert set(prompts) == set(keys.values()) and FI.feedback_prompts(found, include_ok=False).count() == 2
    replies = spark.createDataFrame(
        [(keys["a.py", 0], " fix `it` ", None, 1), (keys["a.py", 1], None, "timeout", 3)], schemas.REPLIES
    )
    got = {(r.filename, r.chunk_index): (r.category, r.confidence, r.feedback) for r in review(files, replies).collect()}
    assert got == {
        ("a.py", 0): ("bug", 0.0, "fix `it`"),
        ("a.py", 1): ("bug", 0.0, "(feedback unavailable: timeout)"),
        ("", 0): ("ok", 0.0, "(feedback unavailable: no reply)"),
    }
    report = FI.report(review(files, replies)).orderBy("chunk_number").collect()
    assert [(r.chunk_number, r.heading, r.confidence_text, r.comment) for r in report] == [
        (1, "BUG", "heuristic", "fix it"), (2, "BUG", "heuristic", "(feedback unavailable: timeout)")]


def many_files(spark, n=60):
    """One review has two thirds of the files; one file has no lines at all."""
    rng = random.Random(4)
    words = ["null", "token", "slow", "naming", "x", "y"]
    rows = [("big" if i % 3 < 2 else f"r{i}", f"f{i:03}.py", "Python", "\n".join(rng.choice(words) for _ in range(i)), i, 0) for i in range(n)]
    return spark.createDataFrame(rows, "review_key string, filename string, language string, patch string, additions int, deletions int")


def test_both_ways_to_nest_agree(spark):
    files = many_files(spark)
    direct = rollups.label_files(files, 7)
    findings = find(files, max_lines=7).withColumn("feedback", F.lit(""))
    nested = rollups.nest_findings(files, findings, "filename")
    a = {r.filename: r for r in direct.collect()}
    b = {r.filename: r for r in nested.collect()}
    assert a == b and len(a) == 59  # the file without a text is no part of a result
    assert [f.chunk_index for f in a["f059.py"].findings] == list(range(9))
    assert "Exchange" not in direct._jdf.queryExecution().executedPlan().toString()


def by_review(results):
    files, totals = {}, {}
    for r in results.collect():
        if r.kind == "file":
            files.setdefault(r.review_key, []).append(r.file)
        else:
            assert r.review_key not in totals
            totals[r.review_key] = r.totals
    return files, totals


@pytest.mark.parametrize("n", [1, 60, 1200])
def test_review_results_have_one_shape(spark, n):
    """A review of one file and one of 800 come out alike: a row per file and one of totals."""
    files = many_files(spark, n) if n < 100 else many_files(spark, 60).drop("filename").crossJoin(
        spark.range(20).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename")))
    labelled = materialise(rollups.label_files(files, 7), "test")
    found, totals = by_review(rollups.review_results(labelled))
    with_text = S.with_patch(files)
    assert sum(map(len, found.values())) == with_text.count()
    assert found.keys() == totals.keys() == {r.review_key for r in with_text.select("review_key").distinct().collect()}
    for key, total in totals.items():
        chunks = [f for file in found[key] for f in file.findings]
        assert total.n_files == len(found[key]) and total.total_chunks == len(chunks)
        assert total.total_issues == sum(f.category != "ok" for f in chunks)
        assert total.category_counts == {c: sum(f.category == c for f in chunks) for c in C.CATEGORIES}
    rows = rollups.result_json(rollups.review_results(labelled)).collect()
    assert {r.kind: list(json.loads(r.json)) for r in rows} == {} if n == 0 else all(
        list(json.loads(r.json)) == (["filename", "language", "additions", "deletions", "findings"] if r.kind == "file"
                                     else ["n_files", "total_chunks", "total_issues", "category_counts"]) for r in rows)


def test_from_records_to_the_response(spark):
    """Files without a patch are no part of a response, names may repeat, a review without a patch has none."""
    landed = spark.createDataFrame(
        [(URL + "1", "a.py", "null\n" * 31, 3, None), (URL + "1", "img.png", None, 1, 1), (URL + "1", None, "x", 1, 1),
         (URL + "1", None, "slow", 1, 1), (URL + "2", "only.png", None, 1, 1), (URL + "3", "t.py", "", 1, 1)],
        schemas.PR_FILES)
    found, totals = by_review(respond(landed))
    assert sorted(f.filename for f in found["o/r/1"]) == ["", "", "a.py"] and set(totals) == {"o/r/1"}
    assert (totals["o/r/1"].n_files, totals["o/r/1"].total_chunks) == (3, 4)
    assert totals["o/r/1"].category_counts == {"bug": 2, "style": 0, "performance": 1, "security": 0, "ok": 1}
    files = with_row_id(materialise(S.from_pr_files(landed), "test"))
    nested = rollups.nest_findings(files, find(files).withColumn("feedback", F.lit("")), "row_id")
    assert sorted(map(repr, nested.collect())) == sorted(map(repr, rollups.label_files(S.from_pr_files(landed)).collect()))
    rejects = S.without_reviewable_file(S.from_pr_files(landed), S.from_pr_files(landed))
    assert sorted(r.review_key for r in rejects.collect()) == ["o/r/2", "o/r/3"]


def test_summary(spark):
    names = ["b.py", "a.py", "", "a.py", "c.py"] + [f"{i}" for i in range(20)]
    rows = [("r", n, "bug") for n in names] + [("r", "z", "security"), ("r", "z", "ok"), ("s", "y", "style")]
    findings = spark.createDataFrame(rows, "review_key string, filename string, category string")
    got = rollups.summary(findings).collect()
    assert [(r.category, r.n, r.n_files) for r in got] == [("bug", 25, 24), ("security", 1, 1), ("style", 1, 1)]
    assert [r.files for r in got] == [", ".join(sorted(set(names)))[:28], "z", "y"]
    per_review = rollups.summary(findings, "review_key").collect()
    assert [(r.review_key, r.category) for r in per_review] == [("r", "bug"), ("r", "security"), ("s", "style")]
    keyed = rollups.summary(findings, "review_key")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(review_key" in keyed and "rangepartitioning(ord" not in keyed
    plan = rollups.summary(findings)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_clean_files_and_validation(spark):
    files = many_files(spark)
    findings = find(files)
    clean = {r.filename for r in filters.clean_files(files, findings, "filename").collect()}
    issues = {r.filename for r in filters.actionable(findings).collect()}
    # The file without a patch is not shown.
    assert clean | issues == {f"f{i:03}.py" for i in range(1, 60)} and not clean & issues
    named = [("1", "r", "a.py", "x"), ("2", "r", "a.py", "null"), ("3", "r", "img.png", None)]
    named = spark.createDataFrame(named, "file_id string, review_key string, filename string, patch string")
    assert [r.file_id for r in filters.clean_files(named, find(named)).collect()] == ["1"]
    rows = findings.withColumn("feedback", F.when(F.col("chunk_index") == 0, "x")).withColumn(
        "category", F.when(F.col("filename") == "f001.py", None).otherwise(F.col("category")))
    valid, rejected = filters.split_findings(rows)
    reasons = {(r.filename, r.chunk_index): r.reason for r in rejected.collect()}
    assert reasons == {("f001.py", 0): "unknown category"} | {(f"f{i:03}.py", 1): "missing feedback" for i in range(31, 60)}
    assert valid.count() + len(reasons) == findings.count()


def test_counts_add_up(spark):
    findings = find(many_files(spark), max_lines=3)
    lines = {r.filename: [] for r in findings.collect()}
    for r in findings.orderBy("filename", "chunk_index").collect():
        lines[r.filename].append(r.chunk)
    for r in many_files(spark).collect():
        if r.patch:
            assert "\n".join(lines[r.filename]) == r.patch
            assert all(c.count("\n") == 2 for c in lines[r.filename][:-1])


def test_continuous_review_equals_the_batch_job(spark, tmp_path):
    landing, out = (str(tmp_path / n) for n in ("landing", "out"))
    files = many_files(spark)
    label = by_keywords()

    def source():
        schema = "review_key string, filename string, language string, patch string, additions int, deletions int"
        return stream.landing_folder(spark, landing, "json", schema, files_per_batch=1)

    def drain():
        stream.write_findings(source(), out, out + "-checkpoint", label, 7).awaitTermination()

    def check(expected):
        found = spark.read.parquet(out)
        want = find(expected, label, 7)
        assert sorted(map(repr, found.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        stream.count_findings(spark, out, out + "-counts").awaitTermination()
        assert {tuple(r) for r in stream.running_counts(spark, out + "-counts").collect()} == {
            tuple(r) for r in want.groupBy("category").count().collect()}

    files.where("additions < 40").repartition(3).write.json(landing)
    drain()
    check(files.where("additions < 40"))
    files.where("additions >= 40").write.mode("append").json(landing)
    drain()
    drain()
    check(files)


@pytest.mark.parametrize("parts", [0, 3])
def test_the_documents_may_be_one_file_or_a_folder_of_files(spark, tmp_path, parts):
    docs = spark.createDataFrame(
        [(i, "hash\n" * (31 if i < 2 else 1), "en", "web", i) for i in range(6)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    path = tmp_path / "documents.parquet"
    if parts:
        docs.repartition(parts).write.parquet(str(path))
    else:
        docs.toPandas().to_parquet(path)
    docs.limit(1).write.parquet(str(tmp_path / "documents.parquet_old"))
    assert CHECKS["continuous_review_findings"].query(spark, str(tmp_path)).count() == 8
    assert [tuple(r) for r in CHECKS["continuous_review_counts"].query(spark, str(tmp_path)).collect()] == [("security", 8)]


def test_results_are_written_as_json(spark, tmp_path):
    path = str(tmp_path / "results")
    results = rollups.review_results(materialise(rollups.label_files(many_files(spark)), "test"))
    rollups.write_results(results, path)
    assert spark.read.json(path).where("kind = 'totals'").count() == 21


def test_a_filter_does_not_label_twice(spark):
    found = filters.actionable(find(many_files(spark)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_max") == 1
    assert rollups.summary(find(many_files(spark)))._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_the_summary_labels_each_chunk_once(spark):
    summary = rollups.summary(find(many_files(spark)))
    summary.collect()
    plan = summary._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("array_max") == 1


def test_roll_ups_of_a_written_findings_table_read_only_their_columns(spark, tmp_path):
    path = str(tmp_path / "findings")
    found = find(many_files(spark)).withColumn("feedback", F.lit(""))
    write_table(found, path)
    summary = rollups.summary(read_findings(spark, path))
    assert summary.collect() == rollups.summary(found).collect()
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<filename:string,category:string>" in plan and "Not(EqualTo(category,ok))" in plan


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(Cluster(), "x")
