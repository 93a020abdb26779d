"""Spelling variants: words one edit apart, each led to its common form.

Words are maximal runs of ``[A-Za-zÀ-ÿ]``, A-Z lower-cased, with at least ``SHORTEST`` code points and
``OFTEN`` occurrences. In one of ``SLIPS`` runs of a document, picked by CRC-32, one code point is left out (a planted slip of the pen).

The vocabulary is sorted and cut into blocks of neighbouring words. A word scans a sorted list with a banded edit matrix of three cells a
row: a row belongs to a prefix of the listed words, so the rows of a word serve the next one as far as their longest common
prefix (LCP), and a prefix whose row exceeds one edit lets the whole range that shares it be skipped. Two words one edit apart share either the first
``len // 2`` code points of the word that scans or the rest of it from the other end, so one scan of the sorted list and one of the list of
reversed words, each below a fixed prefix, find every near word exactly once.

A word goes only to the blocks that can hold a near word: those below its prefix, and where they are many, those that one of its edits
falls into. The first words of the blocks are broadcast; there are at most ``BLOCKS`` blocks and partitions more, as blocks grow with the vocabulary beyond
that. A scan returns counts and the best form, never pairs.

Null texts have no words. A document without an id has no slips, as its runs have no digest. Repeated rows count again. Among near words
of equal counts the smaller in code-point order is the form. An empty table gives no rows. Extra columns of any name are ignored. A text of any length is
split in one task, which holds about 60 bytes for each of its words.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import text_of, written

SHORTEST = 6
OFTEN = 5
SLIPS = 199
TIMES = 5  # a form occurs so many times as often as the word that it corrects
BLOCK = 4096
BLOCKS = 32_768
TASKS = 8192
HELD_WORDS = 300_000
FEW = 4  # so many blocks below a prefix are visited without a look at the edits
LETTERS = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
LAST = "\U0010ffff"

# One byte a code point: other characters become "?", which no run holds.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))

SORTED = "side int, word string, n bigint, block bigint"
ASKED = "side int, word string, n bigint, block bigint, own boolean"
FOUND = "word string, n bigint, n_near bigint, form_n bigint, form string"


def runs(text: str) -> list[bytes]:
    """The lower-cased runs of a text in Latin-1, in order."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in held]
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = Counter(runs(text))
            start = zlib.crc32(b"%d:" % doc_id) if doc_id is not None else 0
            for run, n in found.items():
                if len(run) < SHORTEST:
                    continue
                if doc_id is not None:
                    crc = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if crc % SLIPS == 0:
                        at = crc % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < SHORTEST:
                            continue
                held[run] += n
            if len(held) > HELD_WORDS:
                yield rows()
    yield rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of documents (doc_id, text) that are long and frequent enough."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    counts = texts.mapInArrow(_counts, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _blocks(size: int):
    """Numbers the blocks of a sorted partition; a block ends after ``size`` words, and where a side ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            numbers = []
            for side in batch.column("side").to_pylist():
                if held == size or (last is not None and side != last):
                    block, held = block + 1, 0
                held, last = held + 1, side
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("side", "word", "n")), pa.array(numbers, pa.int64())], names=["side", "word", "n", "block"])

    return run


def fixed(length: int, side: int) -> int:
    """How many first code points of a scanning word of this length its near words on this side share."""
    return length // 2 if side == 0 else length - length // 2


def edits(word: str, i: int) -> Iterator[str]:
    """The strings one edit at place ``i`` leads to."""
    before, after = word[:i], word[i + 1 :]
    yield before + after
    for letter in LETTERS:
        yield before + letter + after
        yield before + letter + word[i:]


def visits(starts: list[str], word: str, depth: int) -> set[int]:
    """The blocks, by their first words, that may hold words one edit from ``word`` which share its first ``depth`` code points."""

    def below(prefix: str) -> tuple[int, int]:
        return max(bisect_right(starts, prefix) - 1, 0), max(bisect_right(starts, prefix + LAST) - 1, 0)

    low, high = below(word[:depth])
    if high - low < FEW:
        return set(range(low, high + 1))
    found = set()
    for i in range(depth, len(word) + 1):
        low, high = below(word[:i])
        if low == high:
            # From here on all edits fall into one block.
            return found | {low}
        found.update(max(bisect_right(starts, near) - 1, 0) for near in edits(word, i))
    return found


def _route(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, tuple[list[str], list[int]]] = sent.value
        for batch in batches:
            out: list[tuple] = []
            for side, word, n, block in zip(*(batch.column(c).to_pylist() for c in ("side", "word", "n", "block")), strict=True):
                out.append((side, word, n, block, True))
                starts, numbers = sides[side]
                for k in visits(starts, word, fixed(len(word), side)):
                    if numbers[k] != block:
                        out.append((side, word, n, numbers[k], False))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["side", "word", "n", "block", "own"])

    return run


def common_prefixes(words: list[str]) -> list[int]:
    """The length of the longest common prefix of each word with the one before it."""
    out = [0]
    for a, b in zip(words, words[1:]):
        k, end = 0, min(len(a), len(b))
        while k < end and a[k] == b[k]:
            k += 1
        out.append(k)
    return out


def scan(words: list[str], lcps: list[int], word: str, depth: int) -> Iterator[int]:
    """Places in the sorted list of words exactly one edit from ``word`` that share its first ``depth`` code points.

    A row holds the edit distances between the first d code points of the listed word and the word's first d - 1, d and
    d + 1; ``rows`` has those from ``depth`` on. Where the next code point leaves no distance of one, the scan goes on at
    the first listed word with a code point that does.
    """
    length = len(word)
    at, end = bisect_left(words, word[:depth]), bisect_left(words, word[:depth] + LAST)
    rows, d = [(1, 0, 1)], depth
    while at < end:
        listed = words[at]
        size = len(listed)
        del rows[d - depth + 1 :]
        left, middle, right = rows[-1]
        while d < size:
            letter = listed[d]
            below = min(left + (letter != word[d - 1]), middle + 1) if d <= length else 2
            same = min(middle + (letter != word[d]), right + 1, below + 1) if d < length else 2
            above = min(right + (letter != word[d + 1]), same + 1) if d + 1 < length else 2
            if below > 1 and same > 1 and above > 1:
                break
            left, middle, right = below, same, above
            rows.append((left, middle, right))
            d += 1
        else:
            if (left, middle, right)[length - size + 1] == 1 if abs(length - size) < 2 else False:
                yield at
            at += 1
            if at < end:
                d = lcps[at]
            continue
        goes = [word[k] for k, cell in ((d - 1, left), (d, middle), (d + 1, right)) if cell == 1 and k < length and word[k] > letter]
        at = bisect_left(words, listed[:d] + (min(goes) if goes else LAST), at + 1, end)
        if at < end:
            d = min(lcps[at], d)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the own words of each block and of its visitors; rows come by block, own words first and sorted."""
    block, side, words, counts, lcps, asked = None, 0, [], [], [], []

    def answers() -> pa.RecordBatch:
        if len(lcps) < len(words):
            lcps[:] = common_prefixes(words)
        out = []
        for word, n in asked:
            half = len(word) // 2
            near, most, form = 0, 0, None
            for k in scan(words, lcps, word, fixed(len(word), side)):
                other = words[k]
                if side:
                    if other[-half:] == word[-half:]:
                        continue  # the list that is not reversed finds it
                    other = other[::-1]
                near += 1
                if counts[k] > most or (counts[k] == most and other < form):
                    most, form = counts[k], other
            out.append((word[::-1] if side else word, n, near, most if near else None, form))
        asked.clear()
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_near", "form_n", "form"])

    for batch in batches:
        for row_side, word, n, number, own in zip(*(batch.column(c).to_pylist() for c in ("side", "word", "n", "block", "own")), strict=True):
            if number != block:
                if asked:
                    yield answers()
                block, side = number, row_side
                words, counts, lcps = [], [], []
            if own:
                words.append(word)
                counts.append(n)
            elif len(asked) >= 2 * BLOCK:
                yield answers()
            asked.append((word, n))
    if asked:
        yield answers()


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of a vocabulary (word, n), a written table."""
    spark = words.sparkSession
    size = words.count()
    block = max(BLOCK, -(-2 * size // BLOCKS))
    sides = words.select(F.lit(0).alias("side"), "word", "n").unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("word"), "n"))
    # Where a range of the list ends is of no matter to the result.
    dealt = sides.repartitionByRange(max(1, -(-2 * size // (4 * block))), "side", "word").sortWithinPartitions("side", "word")
    listed = written(dealt.mapInArrow(_blocks(block), SORTED), "sorted-words")
    starts: dict[int, tuple[list[str], list[int]]] = {0: ([], []), 1: ([], [])}
    for row in listed.groupBy("side", "block").agg(F.min("word").alias("start")).orderBy("side", "start").collect():
        starts[row.side][0].append(row.start)
        starts[row.side][1].append(row.block)
    sent = spark.sparkContext.broadcast(starts)
    asked = listed.mapInArrow(_route(sent), ASKED)
    # Few bytes but much work: the number of tasks follows the number of blocks.
    tasks = max(1, min(TASKS, len(starts[0][0]) + len(starts[1][0])))
    together = asked.repartition(tasks, "block").sortWithinPartitions("block", F.desc("own"), "word")
    best = F.struct((-F.col("form_n")).alias("less"), "form")
    found = together.mapInArrow(_near, FOUND).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("form").isNotNull(), best)).alias("best")
    )
    right = -F.col("best.less") >= TIMES * F.col("n")
    return found.select(
        "word", "n", "n_near", F.when(right, F.col("best.form")).alias("form"), F.when(right, -F.col("best.less")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that a word with a form leads to, for (word, form), a written table.

    Each round doubles the steps; a form is ``TIMES`` times as frequent as its word, so chains are short.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = written(reached.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        reached = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return reached


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of documents (doc_id, text)."""
    words = written(vocabulary(docs), "vocabulary")
    near = written(near_words(words), "near-words")
    last = roots(near.where("form IS NOT NULL").select("word", "form"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
