import random
import re

import pytest
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import display, labels as L
from patchlight.functions.naming import language
from patchlight.functions.prompts import category_prompt, feedback_prompt, judge_prompt
from patchlight.sources import changed_files as S


def column(spark, values, expression, type="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"id int, v {type}")
    return [r.out for r in rows.select("id", expression(F.col("v")).alias("out")).orderBy("id").collect()]


WEAK = [
    ("security bug", "APPROVE", "ok"),
    ("Fixes a token bug", "REQUEST_CHANGES", "security"),
    ("slow and wrong", "REQUEST_CHANGES", "bug"),
    ("slow, odd naming", "REQUEST_CHANGES", "performance"),
    ("clean up", "REQUEST_CHANGES", "style"),
    ("cleanup", "REQUEST_CHANGES", "style"),
    ("inefficient", "REQUEST_CHANGES", "bug"),
    ("api_token", "REQUEST_CHANGES", "bug"),
    ("O(n log n)", "REQUEST_CHANGES", "performance"),
    ("authé x", "REQUEST_CHANGES", "security"),
    ("tokené", "REQUEST_CHANGES", "bug"),
    (None, "APPROVE", "ok"),
    (None, "REQUEST_CHANGES", "bug"),
    ("nothing", "approve", "bug"),
    ("nothing", None, "bug"),
]


def test_weak_label(spark):
    rows = spark.createDataFrame(WEAK, "e string, v string, want string")
    got = rows.select("*", L.weak_label(F.col("e"), F.col("v")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


HEURISTIC = {
    "x = 1": "ok",
    "password = secret": "security",
    "null error password secret": "bug",
    "import slow": "style",
    "banana": "bug",
    "error error error password secret": "security",
    "": "ok",
    "EVAL(x) Password": "security",
}


def test_heuristic_label(spark):
    assert column(spark, list(HEURISTIC), L.heuristic_label) == list(HEURISTIC.values())


def test_heuristic_label_on_random_texts(spark):
    rng = random.Random(11)
    words = [k for ks in C.HEURISTIC_KEYWORDS.values() for k in ks] + ["x", "Y", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))).title() for _ in range(400)]

    def expected(text):
        hits = {c: sum(k in text.lower() for k in C.HEURISTIC_KEYWORDS.get(c, [])) for c in C.CATEGORIES}
        top = max(hits.values())
        return next(c for c in C.CATEGORIES if hits[c] == top) if top else "ok"

    assert column(spark, texts, L.heuristic_label) == [expected(t) for t in texts]


REPLIES = {
    "LABEL: bug\nCONFIDENCE: high": ("bug", "high"),
    "label:Security": ("security", "unknown"),
    "LABEL:\n\n ok": ("ok", "unknown"),
    "LABEL: bug_fix": (None, None),
    "**LABEL:** bug": (None, None),
    "LABEL: feature\nCONFIDENCE: low": (None, None),
    "nothing": (None, None),
    "LABEL: bug LABEL: ok CONFIDENCE: Whatever": ("bug", "whatever"),
    "LABEL:\x1cstyle\nconfidence:\x1dLow": ("style", "low"),
}


def test_judge_reply(spark):
    got = zip(column(spark, list(REPLIES), L.judge_label), column(spark, list(REPLIES), L.judge_confidence))
    assert list(got) == list(REPLIES.values())


def test_category_index_round_trip(spark):
    assert column(spark, C.CATEGORIES + ["x", None], L.category_index) == [0, 1, 2, 3, 4, None, None]
    assert column(spark, [0, 4, None, 9], L.category_of, "int") == ["bug", "ok", None, None]


def test_top_category_takes_the_first_maximum(spark):
    values = [[0.1, 0.4, 0.4, 0.05, 0.05], [0.0, 0.0, 0.0, 0.0, 1.0]]
    assert column(spark, values, L.top_category, "array<double>") == ["style", "ok"]
    assert column(spark, values, L.top_confidence, "array<double>") == [0.4, 1.0]


def test_language(spark):
    cases = {"a.py": "Python", "A.PY": "Python", ".py": "Python", "x.D.TS": "TypeScript", "Makefile": "Unknown",
             "x.tar.gz": "Unknown", "foo.": "Unknown", "a.b/Makefile": "Unknown", "": "Unknown", "py": "Unknown"}
    assert column(spark, list(cases), language) == list(cases.values())


def test_pr_urls(spark):
    urls = ["https://github.com/o/r/pull/12", "github.com/o/r/pull/12/files?x=1", "https://gitlab.com/o/r/pull/1",
            "https://github.com/o/r/pulls/1", "https://github.com/o/r/pull/99999999999999999999", None]
    rows = spark.createDataFrame([(u,) for u in urls], "pr_url string")
    got = [(r.owner, r.repo, r.pr_number) for r in S.parse_pr_urls(rows).collect()]
    assert got == [("o", "r", 12), ("o", "r", 12)] + [(None, None, None)] * 4
    assert S.invalid_pr_urls(rows).count() == 4


def test_prompts_keep_any_character(spark):
    code = "100% {code} {chunk} $1 \\n " + "x" * 2000
    assert column(spark, [code], judge_prompt) == [C.JUDGE_PROMPT.replace("{code}", code[:1500], 1)]
    got = column(spark, [code], lambda c: feedback_prompt(F.lit("bug"), c))
    assert got == [C.FEEDBACK_PROMPT.replace("{category}", "bug").replace("{chunk}", code, 1)]
    assert column(spark, ["x"], lambda c: category_prompt(F.lit("ok"), c)) == [C.CATEGORY_PROMPTS["ok"] + "x"]


def test_display(spark):
    assert column(spark, ["```py\nx```  use `a` \n", " plain ", "```\n\na``b`", "no `end"], display.plain_feedback) == [
        "x  use a", "plain", "a``b`".replace("``b`", "`b"), "no `end"]
    assert column(spark, [0.125, 0.0, 0.995, 1.0], display.percent, "double") == [13, 0, 100, 100]
    assert column(spark, [0.125, 0.375, 0.0], display.percent_even, "double") == [12, 38, 0]
    assert column(spark, [0.0, 0.5], display.confidence_text, "double") == ["heuristic", "50% confidence"]
    assert column(spark, ["bug", "ok", "other", None], display.display_name) == ["Bug", "Clean", "Clean", "Clean"]
    assert column(spark, ["x" * 300], display.code_preview) == ["x" * 200 + "..."]


def test_feedback_or_reason(spark):
    rows = spark.createDataFrame([(" good \n", None), (None, "timeout"), (None, None), ("", None)], "r string, e string")
    got = [r.f for r in rows.select(display.feedback_or_reason(F.col("r"), F.col("e")).alias("f")).collect()]
    assert got == ["good", "(feedback unavailable: timeout)", "(feedback unavailable: no reply)", ""]


def test_fallback_below_threshold(spark):
    rows = spark.createDataFrame([("ok", 0.2, "null"), ("ok", 0.9, "null")], "category string, confidence double, chunk string")
    category, confidence = L.with_fallback(F.col("category"), F.col("confidence"), F.col("chunk"), 0.5)
    assert [tuple(r) for r in rows.select(category, confidence).collect()] == [("bug", 0.0), ("ok", 0.9)]


@pytest.mark.parametrize("name", list(C.WEAK_LABEL_PATTERNS))
def test_pattern_tables_are_sound(name):
    for pattern in C.WEAK_LABEL_PATTERNS[name]:
        re.compile(pattern)
    assert sum(map(len, C.WEAK_LABEL_PATTERNS.values())) == 49
    assert sum(map(len, C.HEURISTIC_KEYWORDS.values())) == 62
