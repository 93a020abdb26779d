"""Secrets in texts: fixed patterns, and values next to a credential word that would take many guesses.

The base finds three kinds by pattern: ``assign`` (a credential word with a long value), ``access`` (key ids) and ``hex`` (long hexadecimal
runs). The method looks at values in a wider set of credential contexts, of any length and any characters, and works out what
it costs to guess them: a dynamic program over the value finds the cheapest way to cut it into words, dates, repeats, keyboard
walks and brute-force spans. A value that takes 10^``GUESSES`` guesses or more and touches no base span becomes a span of kind ``guess``.

Costs are decimal logarithms and add up along the cut; every segment costs the choice of its kind. The words are those of the corpus itself, all
of it: a word of n occurrences among N costs log10(N / n). Credential values are not counted, so a secret that a thousand copies repeat does not
become a word. Only the pieces of values are joined with the counts, and nothing is broadcast.

Null texts are empty and have no spans. Every row of the input gives one row, repeated rows and rows without an id too. Equal
values are judged once. An empty table gives no rows. Extra columns of any name are ignored. Spans are in code points, end
exclusive, ordered by start and then by kind. A text is read whole by one task; a value of m letters has up to 22 * m pieces, whatever its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import text_of, written

KINDS = ["assign", "access", "hex", "guess"]
GUESSES = 8.0
OFTEN = 5
SHORTEST, LONGEST = 3, 24
PERIODS = 16
HELD_WORDS = 300_000

# Fixed values of the base.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so these are the runs of 16 or more
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

_WORDS = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client|signing|account|service)[\x20_-]?(?:key|secret|token)"
_VALUE = r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'`<>,;(){}\[\]]++)(?!\())"""
CONTEXT = re.compile(
    rf"""(?:(?:{_WORDS})["'`]?\x20*(?:=>|:=|[:=]|\x20is\x20)\x20*{_VALUE}|\b(?:bearer|basic)\x20+([A-Za-z0-9._~+/=-]++)|://[^\s/:@]*:([^\s/@]+)@)""",
    re.I | re.A,
)
_HINTS = [b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"key", b"bearer", b"basic", b"://"]
_IS_HEX = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))

# What a step of the cut costs.
KIND = math.log10(5)
TWICE = math.log10(2)
START, TURN = math.log10(73), math.log10(8)
YEARS, DAYS, GAPS = math.log10(200), math.log10(366), math.log10(5)
POOLS = {"digit": 1.0, "lower": math.log10(26), "upper": math.log10(26), "sign": math.log10(33), "other": 4.0}

_SPOKEN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})
_ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
DATES = [
    (re.compile(_YEAR, re.A), YEARS),
    (re.compile(rf"{_DAY}{_MONTH}{_YEAR}|{_MONTH}{_DAY}{_YEAR}", re.A), YEARS + DAYS + TWICE),
    (re.compile(rf"{_YEAR}{_MONTH}{_DAY}", re.A), YEARS + DAYS),
    (re.compile(rf"{_DAY}{_MONTH}\d\d|\d\d{_MONTH}{_DAY}", re.A), 2.0 + DAYS + TWICE),
    (re.compile(rf"{_YEAR}([-/._ ]){_MONTH}\1{_DAY}", re.A), YEARS + DAYS + GAPS),
    (re.compile(rf"{_DAY}([-/._ ]){_MONTH}\1{_YEAR}", re.A), YEARS + DAYS + GAPS),
]


def _steps() -> dict[tuple[str, str], set[int]]:
    """The directions in which one key follows another: along a row, to the rows above and below, and along the alphabet."""
    found: dict[tuple[str, str], set[int]] = {}
    for r, row in enumerate(_ROWS):
        for c, key in enumerate(row):
            for direction, (dr, dc) in enumerate([(0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)]):
                # The top row stands one key to the left.
                shift = (r == 0) * -dr + (r + dr == 0) * -dr if dr else 0
                if 0 <= r + dr < len(_ROWS) and 0 <= c + dc + shift < len(_ROWS[r + dr]):
                    found.setdefault((key, _ROWS[r + dr][c + dc + shift]), set()).add(direction)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for a, b in zip(letters, letters[1:]):
        found.setdefault((a, b), set()).add(6)
        found.setdefault((b, a), set()).add(7)
    return found


STEPS = _steps()


def keys(value: str) -> str:
    """The keys that are pressed for a value, without shift."""
    return "".join(c.lower() if c.isascii() else c for c in value.translate(_SHIFTED))


def char_cost(c: str) -> float:
    if not c.isascii():
        return POOLS["other"]
    return POOLS["digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "sign"]


def spoken(value: str) -> str:
    """Lower-case letters, with digits and signs read as the letters they stand for."""
    lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return lowered.translate(_SPOKEN)


def pieces(value: str) -> set[str]:
    """The strings of letters within a value that may be words."""
    read = spoken(value)
    found = set()
    for run in re.finditer(r"[^\W\d_]+", read):
        word = run.group()
        for i in range(len(word) - SHORTEST + 1):
            found.update(word[i:j] for j in range(i + SHORTEST, min(i + LONGEST, len(word)) + 1))
    return found


def word_cost(written_as: str, n: int, total: int) -> float:
    """A word by its share of all words, by its capitals, and by the letters written as other signs."""
    capitals = sum(c.isupper() for c in written_as)
    shape = 0.0 if not capitals else TWICE if capitals == len(written_as) or (capitals == 1 and written_as[0].isupper()) else len(written_as) * TWICE
    signs = sum(not c.isalpha() for c in written_as)
    return math.log10(max(total, n) / n) + shape + signs * TWICE


def guess_cost(value: str, words: Mapping[str, int], total: int) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that a value takes, and its cheapest segments (kind, start, end).

    ``best[i]`` is the least cost of the first i code points. A brute-force span, a repeat of the code points before it and a
    walk may go on: their costs so far are kept per state, with the place where they began.
    """
    n, read, pressed = len(value), spoken(value), keys(value)
    best: list[float] = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute, brute_from = math.inf, 0
    walks: dict[int, tuple[float, int]] = {}
    repeats: dict[tuple[int, int], tuple[float, int]] = {}

    def reach(end: int, cost: float, kind: str, start: int) -> None:
        if cost < best[end]:
            best[end], back[end] = cost, (kind, start)

    for i in range(n):
        # All segments that end here are known; now those that begin here or go on.
        if best[i] + KIND < brute:
            brute, brute_from = best[i] + KIND, i
        brute += char_cost(value[i])
        reach(i + 1, brute, "brute", brute_from)

        for j in range(i + SHORTEST, min(i + LONGEST, n) + 1):
            if not read[j - 1].isalpha():
                break
            if read[i].isalpha() and (count := words.get(read[i:j])):
                reach(j, best[i] + KIND + word_cost(value[i:j], count, total), "word", i)

        if value[i].isdigit():
            for pattern, cost in DATES:
                if match := pattern.match(value, i):
                    reach(match.end(), best[i] + KIND + cost, "date", i)

        for p in range(1, min(PERIODS, i, n - i) + 1):
            before = repeats.pop((i, p), (math.inf, i))
            if value[i : i + p] == value[i - p : i]:
                went = min((before[0] + TWICE, before[1]), (best[i] + KIND + math.log10(PERIODS), i))
                repeats[i + p, p] = went
                reach(i + p, went[0], "repeat", went[1])

        if i:
            shifted = TWICE * (pressed[i] != value[i])
            goes: dict[int, tuple[float, int]] = {}
            turned = min(walks.values(), default=(math.inf, i))
            begun = best[i - 1] + KIND + START + TURN + TWICE * (pressed[i - 1] != value[i - 1])
            for direction in STEPS.get((pressed[i - 1], pressed[i]), ()):
                on = walks.get(direction, (math.inf, i))
                goes[direction] = min((on[0] + TWICE + shifted, on[1]), (turned[0] + TURN + shifted, turned[1]), (begun + shifted, i - 1))
            walks = goes
            for cost, start in goes.values():
                reach(i + 1, cost, "walk", start)

    segments, end = [], n
    while end:
        kind, start = back[end]
        segments.append((kind, start, end))
        end = start
    return best[n], segments[::-1]


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the base, by kind."""
    found = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    return found + [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]


def context_values(text: str) -> list[tuple[int, int]]:
    """Start and end of the values next to a credential word, without the punctuation that ends a sentence."""
    found = []
    for m in CONTEXT.finditer(text):
        group = m.lastindex
        value = m[group].rstrip(".!?:") if group == 3 else m[group]
        if value:
            found.append((m.start(group), m.start(group) + len(value)))
    return found


def candidates(raw: bytes) -> list[tuple[str, int, int, int]]:
    """Base spans and the context values that touch none of them, as (kind, start, end, start of the value)."""
    folded = raw.lower()
    hinted = any(hint in folded for hint in _HINTS)
    if not hinted and b"AKIA" not in raw and b"h" * HEX_LENGTH not in raw.translate(_IS_HEX):
        return []
    text = raw.decode()
    found = base_spans(text)
    if hinted:
        taken = [(start, end) for _, start, end, _ in found]
        found += [("guess", a, b, a) for a, b in context_values(text) if all(b <= start or a >= end for start, end in taken)]
    return found


CANDIDATES = "row_id bigint, doc_id bigint, spans array<struct<kind: string, start: int, stop: int, value: string>>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())])
    for batch in batches:
        spans = []
        for raw in batch.column("text").to_pylist():
            found = candidates(raw)
            text = raw.decode() if found else ""
            spans.append([{"kind": k, "start": a, "stop": b, "value": text[v:b]} for k, a, b, v in found])
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"), pa.array(spans, pa.list_(span))], names=["row_id", "doc_id", "spans"])
        row += n


_OUTSIDE = re.compile(r"[^\W\d_]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words outside credential values."""
    held: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for run, n in held.items():
            word = run.decode()
            if word.isalpha():
                words["".join(c.lower() if len(c.lower()) == 1 else c for c in word)] += n
            else:
                for part in _OUTSIDE.findall(word):
                    words["".join(c.lower() if len(c.lower()) == 1 else c for c in part)] += n
        held.clear()
        kept = {w: n for w, n in words.items() if SHORTEST <= len(w) <= LONGEST}
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for raw in batch.column("text").to_pylist():
            found = candidates(raw)
            if found:
                text, at, rest = raw.decode(), 0, []
                for _, _, end, start in sorted(found, key=lambda s: s[3]):
                    rest.append(text[at : max(start, at)])
                    at = max(at, end)
                raw = " ".join([*rest, text[at:]]).encode()
            held.update(raw.translate(_FOLD).split())
            if len(held) > HELD_WORDS:
                yield from rows()
    yield from rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of documents (text) outside credential values, in ``OFTEN`` places or more."""
    counts = docs.select(text_of().cast("binary").alias("text")).mapInArrow(_word_counts, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for digest, value in zip(batch.column("digest").to_pylist(), batch.column("value").to_pylist(), strict=True):
            found = list(pieces(value))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(digest, pa.binary()), len(found)), pa.array(found, pa.string())], names=["digest", "word"]
            )


def _costs(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [
                guess_cost(value, {k["word"]: k["n"] for k in known or ()}, total)[0]
                for value, known in zip(batch.column("value").to_pylist(), batch.column("known").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(costs, pa.float64())], names=["digest", "cost"])

    return run


def find_secrets(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """row_id, doc_id and spans (kind, start, stop, value, cost) of every row of documents (doc_id, text).

    ``cost`` is log10 of the guesses, for ``assign`` and ``guess`` spans.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    rows = written(texts.mapInArrow(_candidates, CANDIDATES), "secret-candidates")
    spans = rows.where(F.size("spans") > 0).select("row_id", F.explode("spans").alias("span")).select("row_id", "span.*")
    judged = F.col("kind").isin("assign", "guess")
    spans = written(spans.withColumn("digest", F.when(judged, F.unhex(F.sha2("value", 256)))), "secret-spans")
    values = written(spans.where("digest IS NOT NULL").groupBy("digest").agg(F.first("value").alias("value")), "secret-values")

    counts = written(word_counts(docs), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first().total
    known = values.mapInArrow(_pieces, "digest binary, word string").join(counts, "word")
    known = known.groupBy("digest").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    costs = values.join(known, "digest", "left").mapInArrow(_costs(total), "digest binary, cost double")

    found = spans.join(written(costs, "guess-costs"), "digest", "left").where((F.col("kind") != "guess") | (F.col("cost") >= guesses))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", place.alias("place"), "kind", "stop", "value", "cost")
    listed = found.groupBy("row_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    with_spans = rows.where(F.size("spans") > 0).select("row_id", "doc_id").join(listed, "row_id", "left")
    none = rows.where(F.size("spans") == 0).select("row_id", "doc_id", F.lit(None).cast(listed.schema["spans"].dataType).alias("spans"))
    kept = F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(s.kind, s.start, s.stop, s.value, s.cost))
    return with_spans.unionByName(none).select("row_id", "doc_id", kept.alias("spans"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the kinds, digest of the base spans, all spans."""

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind != "guess")
    return find_secrets(docs).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("guess"),
    )
