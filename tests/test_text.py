"""Text expressions against the behaviour of Python's own strings and patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import text as X
from patchlight.operators.chunks import explode_chunks
from patchlight.sources.code_files import code_text

LINE_CASES = [
    "", "a", "a\n", "\n", "\n\n", "a\n\n", "a\r\nb\rc", "\r\n", "\r\n\r\n", "\n\r",
    "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "x\x1fy", "a ", "\x85", "é\nü",
    "\n".join(map(str, range(30))), "\n".join(map(str, range(31))), "\n".join(map(str, range(65))),
    "\n" * 30, "\n" * 31, "\n" * 61, "x\n" * 60, "\U0001f600\n\U0001f600",
]


def python_chunks(text, k):
    lines = text.splitlines()
    return ["\n".join(lines[i : i + k]) for i in range(0, len(lines), k)]


def _random_texts(n=200):
    rng = random.Random(7)
    alphabet = "ab \n\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  é"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 2, 5, 30])
def test_chunks_are_the_split_lines(spark, k):
    texts = LINE_CASES + _random_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, patch string")
    got = rows.select(
        "id", X.line_chunks(F.col("patch"), k).alias("c"), X.line_count(F.col("patch")).alias("n")
    ).collect()
    for row in got:
        assert row.c == python_chunks(texts[row.id], k), repr(texts[row.id])
        assert row.n == len(texts[row.id].splitlines())


def test_explode_keeps_order_and_other_columns(spark):
    rows = spark.createDataFrame([("f", "1\n2\n3"), ("g", "")], "filename string, patch string")
    got = explode_chunks(rows, 2).collect()
    assert [tuple(r) for r in got] == [("f", 0, "1\n2"), ("f", 1, "3")]


def test_max_lines_must_be_positive():
    with pytest.raises(ValueError):
        X.line_chunks(None, 0)


def test_strip_and_has_content(spark):
    texts = [" a ", " a　", "\x1c\x1da\x1f", "a b", "", " \t\n\x0b ", "​a", "\x85a "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for row in rows.select("id", X.strip(F.col("t")).alias("s"), X.has_content(F.col("t")).alias("h")).collect():
        assert row.s == texts[row.id].strip()
        assert row.h == bool(texts[row.id].strip())


def test_patterns_match_like_python(spark):
    rng = random.Random(3)
    words = ["security", "auth", "authé", "tokené", "token", "api_token", "fix", "fixes", "fixed", "fixing",
             "o(n", "o(n log n)", "foo(n", "clean up", "cleanup", "clean up", "clean\x1cup", "clean  up", "edge case",
             "off-by-one", "off by one", "offby one", "does not work", "does not worked", "inefficient",
             "efficiency", "null", "nullé", "²null", "null²", "_null", "x-null-y", "memory leak", "lint", "linting"]
    glue = [" ", "", "_", ".", "é", "\n", "-"]
    texts = ["".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(1, 4))) for _ in range(600)] + words
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = rows.select(
        "id", *[X.matches_any(F.col("t"), F.col("t").cast("binary"), p).alias(c) for c, p in C.WEAK_LABEL_PATTERNS.items()]
    ).collect()
    for row in got:
        for category, patterns in C.WEAK_LABEL_PATTERNS.items():
            assert row[category] == any(re.search(p, texts[row.id]) for p in patterns), (category, texts[row.id])


def test_each_pattern_alone_matches_like_python(spark):
    patterns = [p for ps in C.WEAK_LABEL_PATTERNS.values() for p in ps] + [
        r"\w+\s\w+", r"a\b.\bb", r"\b\d", r"x*\b", r"\bx?b", r"\btoken|bug", r"\ba\w*\b", r"\b-?a", r"x?a\b", r"\bbu+g\b",
    ]
    texts = ["a token", "tokens", "vulnerability!", "bug", "debug", "a.b", "a b", "ab", "1x", "é1", "x", "", "o(n)", "xo(n", "cleanup"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = rows.select("id", *[F.col("t").rlike("(?U)" + X.java_pattern(p)).alias(str(i)) for i, p in enumerate(patterns)]).collect()
    for row in got:
        for i, p in enumerate(patterns):
            assert row[str(i)] == bool(re.search(p, texts[row.id])), (p, texts[row.id])


def test_first_chars_counts_code_points(spark):
    row = spark.createDataFrame([("\U0001f600b\U0001f600d",)], "t string").select(
        X.first_chars(F.col("t"), 3).alias("s")
    ).first()
    assert row.s == "\U0001f600b\U0001f600"


def test_decode_drops_invalid_bytes(spark):
    rng = random.Random(5)
    cases = [b"", b"abc", "é�€\U0001f600".encode(), b"a\xffb", b"\xc3", b"\xe2\x82A", b"\xed\xa0\x80x", b"\xf5\x80", b"\xc0\xaf",
             b"\x80\x80a", b"\xf0\x9f\x98", b"\xf0\x9f\x98\x80\x80", b"\xe0\x80\x80", b"\xf4\x90\x80\x80", b"\x00a"]
    cases += [bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0xED, 0xA0, 0xFF, 0xF4, 0x8F]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(cases)], "id int, b binary")
    for row in rows.select("id", X.decode_utf8_ignore(F.col("b")).alias("t")).collect():
        assert row.t == cases[row.id].decode("utf-8", "ignore"), cases[row.id]


def test_code_text_unifies_line_feeds(spark):
    row = spark.createDataFrame([(bytearray(b"a\r\nb\rc\xff"),)], "b binary").select(code_text(F.col("b")).alias("t")).first()
    assert row.t == "a\nb\nc"


def test_stable_bucket_is_even_and_repeatable(spark):
    got = spark.range(4000).select(X.stable_bucket(F.col("id").cast("string"), 8).alias("b")).groupBy("b").count().collect()
    assert {r.b for r in got} == set(range(8))
    assert all(400 < r["count"] < 600 for r in got)


def test_lists_of_patterns_match_like_python(spark):
    lists = [
        [r"\bx?b", r"\btoken\b"], [r"\btoken|bug", r"\bnull\b"], [r"\bfixe?s\b", r"\bo\(n"], [r"au\w*\b", r"\bab{0}c"],
        [r"\b(?:ab|cd)", r"\bz"], [r"\bclean\s?up\b", r"\boff[- ]by\b"],
    ]
    rng = random.Random(9)
    parts = ["x", "b", "token", "bug", "null", "fixes", "fixs", "o(n", "auth", "ac", "abc", "cd", "z", "clean", "up", "off", "by", " ", "-", "_", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = rows.select("id", *[X.matches_any(F.col("t"), F.col("t").cast("binary"), p).alias(str(i)) for i, p in enumerate(lists)]).collect()
    for row in got:
        for i, patterns in enumerate(lists):
            assert row[str(i)] == any(re.search(p, texts[row.id]) for p in patterns), (patterns, texts[row.id])


def test_literal_start():
    cases = {r"\bfix(?:es|ed)?\b": "fix", r"\bo\(n": "o(n", r"\bclean\s?up\b": "clean", r"fixe?s": "fix", r"a|b": "",
             r"\bx?b": "", r"\bedge case\b": "edge case", r"\w+a": "", r"\boff[- ]by": "off", r"au\w*\b": "au"}
    assert {p: X.literal_start(p) for p in cases} == cases
