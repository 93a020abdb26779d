"""Language model scores by Brown's class-based n-grams.

Tokens are the words between ASCII white space, with A-Z in lower case, and one end per text. The most frequent
words (``HEAD``) belong to classes that exchange clustering finds: all words start in some class, and
in each step every word of one part moves to the class under which its neighbours on both sides are
likeliest, given the classes of all others. The pairs of classes are counted anew after each step; a step that does not raise their
likelihood is taken back and the parts are halved, and when two steps together raise it by less than ``RISE`` a pair of words, it ends.
The counts of a word's neighbours lie with the word, so a step is two passes over ``HEAD`` rows, to which only the class of each word and a
table of class pairs are sent. Words behind the head that occur ``SEEN`` times or more then join the class under which their own
neighbours are likeliest, in one pass over the texts. All other words, known or not, belong to classes by their spelling (length, last
sign, kind of letters), and the end to its own.

The probability of a token is that of its class after the two classes before it (Witten-Bell interpolation of
trigrams, bigrams and unigrams of classes) times that of the word in its class. In a class by spelling, absolute
discounting sets mass aside for one unknown word. So the probabilities of all events after any two classes add up to 1.

Counts of all words are a table. The ``KEPT`` most frequent words, of at most ``LONGEST`` bytes, are sent
to the tasks; the others are joined by word. Ties at both cuts go by the word, and ties of classes to the first. Null texts are empty: one
end. A row without an id is neither learned from nor held out. Repeated rows are texts of their own. Without training rows every token is
unknown; an empty table gives no rows. Other columns are not read. A text is split whole, in one task: about 60 bytes a word.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import pack, text_of, unpack, written

HEAD = 8192
KEPT = 150_000
LONGEST = 64
CLASSES = 45
SHAPES = 18
ALL = CLASSES + SHAPES + 1
LAST = ALL - 1  # the class of the end
STEPS = 40  # of the exchange, at most
RISE = 0.002
SEEN = 2
DISCOUNT = 0.75
END = b"\n"  # no word holds a line end
FLUSH = 400_000
CACHE = 200_000
HELD = 2_000_000
GROUPS = 64
PLACES, PLACE_BYTES = 4096, 10 << 20
BLOCK = "part int, block binary"
PRIOR = 0.1

SCORED = (
    "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
    "tail array<struct<word: string, shape: int>>"
)


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()  # of bytes, which is about ASCII only
    words.append(END)
    return words


SIGN = re.compile(rb"[0-9@/<>|#$%&*=_]")


def shape(word: bytes) -> int:
    """The class by spelling, from 0: three lengths, a letter at the end or not, three kinds of signs."""
    size = 0 if len(word) <= 5 else 1 if len(word) <= 9 else 2
    closed = 0 if word[-1:].isalpha() or word[-1] >= 0x80 else 1
    kind = 2 if SIGN.search(word) else 0 if word.isascii() else 1
    return (size * 2 + closed) * 3 + kind


def training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(False))


def raw(docs: DataFrame, *others: Column | str) -> DataFrame:
    """The texts as bytes, null as none."""
    return docs.select(*others, text_of().cast("binary").alias("text"))


def _batch(names: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names.split())


def count_words(texts: DataFrame) -> DataFrame:
    """word, c of all tokens of ``texts`` (text); each task adds up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            out = _batch("word c", words, pa.array(list(held.values()), pa.int64()))
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(tokens(text))
                if len(held) >= FLUSH:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """The words that are sent to the tasks, the most frequent first, with their counts."""

    name: str
    words: list[bytes]
    counts: np.ndarray


class Symbols:
    """Number of a word: its place among the words sent, or else one of the shapes after them.

    The others are remembered too, up to a bound.
    """

    def __init__(self, known: Words) -> None:
        self.first = len(known.words)
        self.table = {word: k for k, word in enumerate(known.words)}
        self.others: list[bytes] = []

    def of(self, words: list[bytes]) -> list[int]:
        found = list(map(self.table.get, words))
        if None in found:
            if len(self.others) > CACHE:
                for word in self.others:
                    del self.table[word]
                self.others = []
            for k, number in enumerate(found):
                if number is None:
                    word = words[k]
                    number = self.table.get(word)
                    if number is None:
                        number = self.table[word] = self.first + shape(word)
                        self.others.append(word)
                    found[k] = number
        return found


_last: list = [None, None]


def symbols_of(known: Words) -> Symbols:
    """The table of the words, kept for the next task of the same Python process."""
    if _last[0] != known.name:
        _last[:] = known.name, Symbols(known)
    return _last[1]


def number(texts: DataFrame, known: Words) -> DataFrame:
    """ids of all ``texts`` (text): the symbols of its tokens, as 32-bit integers."""
    sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = symbols_of(pickle.loads(sent.value))
        for batch in batches:
            ids = [np.array(symbols.of(tokens(text)), "<i4").tobytes() for text in batch.column("text").to_pylist()]
            yield _batch("ids", pa.array(ids, pa.binary()))

    return texts.mapInArrow(run, "ids binary")


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(block.as_py(), "<i4") for block in batch.column("ids"))


def spellings(known: Words) -> np.ndarray:
    """Class by symbol, by spelling alone."""
    return np.array([LAST if word == END else CLASSES + shape(word) for word in known.words] + list(range(CLASSES, LAST)), np.int64)


def _grouped(parts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Keys and counts as one packed block per part."""
    order = np.lexsort((keys, parts))
    parts, keys, counts = parts[order], keys[order], counts[order]
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    spans = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(parts)])]
    blocks = [pack([keys[at], counts[at]]) for at in spans]
    return _batch("part block", pa.array(parts[starts], pa.int32()), pa.array(blocks, pa.binary()))


def _merged(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all blocks, ascending, and the sums of their counts."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[list[np.ndarray]] = []

    def merge() -> None:
        nonlocal keys, counts
        more = np.concatenate([keys, *[h[0].view(np.int64) for h in held]])
        n = np.concatenate([counts, *[h[1].view(np.int64) for h in held]])
        held.clear()
        order = np.argsort(more, kind="stable")
        more, n = more[order], n[order]
        starts = np.flatnonzero(np.diff(more, prepend=-1)) if len(more) else np.zeros(0, np.int64)
        keys, counts = more[starts], np.add.reduceat(n, starts) if len(starts) else n

    size = 0
    for batch in batches:
        for block in batch.column("block"):
            held.append(unpack(block.as_py(), 2))
            size += len(held[-1][0])
            if size >= HELD + len(keys):
                merge()
                size = 0
    merge()
    return keys, counts


def neighbours(numbered: DataFrame, spelled: np.ndarray, head: int) -> DataFrame:
    """For each head word the numbers of its neighbours and their counts: (word, others, counts).

    A neighbour is 2 * symbol, and 1 more on the right side; words behind the head are told apart by spelling
    only, so a row has at most 2 * (head + SHAPES + 1) of them. ``numbered`` is the table of ``number``.
    """
    width = head + SHAPES + 1
    narrow = np.where(np.arange(len(spelled)) < head, np.arange(len(spelled)), head + spelled - CLASSES)
    narrow[spelled == LAST] = head + SHAPES
    sent = numbered.sparkSession.sparkContext.broadcast(narrow)
    size = numbered.agg(F.sum(F.octet_length("ids").cast("long"))).first()[0] or 0
    places = min(PLACES, max(GROUPS, math.ceil(size / PLACE_BYTES)))

    def spread(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % places

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow, end = sent.value, head + SHAPES
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            some = (keys // width < head) | (keys % width < head)
            return _grouped(spread(keys[some]), keys[some], n[some])

        for batch in batches:
            for ids in _ids(batch):
                ids = narrow[ids]
                held.append(np.append(end, ids[:-1]) * width + ids)
                size += len(ids)
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every pair once, with its count, sent to its head words."""
        keys, n = _merged(batches)
        left, right = keys // width, keys % width
        word = np.concatenate([left[left < head], right[right < head]])
        other = np.concatenate([2 * right[left < head] + 1, 2 * left[right < head]])
        count = np.concatenate([n[left < head], n[right < head]])
        if len(word):
            yield _grouped(word % GROUPS, word * (2 * width) + other, count)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(batches)
        words, starts = np.unique(keys // (2 * width), return_index=True)
        ends = np.append(starts[1:], len(keys))
        others = (keys % (2 * width)).astype("<i4")
        for a in range(0, len(words), 256):
            part = range(a, min(a + 256, len(words)))
            yield _batch(
                "word others counts",
                pa.array(words[part.start : part.stop], pa.int32()),
                pa.array([others[starts[k] : ends[k]].tobytes() for k in part], pa.binary()),
                pa.array([counts[starts[k] : ends[k]].astype("<i8").tobytes() for k in part], pa.binary()),
            )

    # Counts meet by pair, in as many places as the input asks for; there are at most width ** 2 pairs, so what then
    # goes on to the words is bounded.
    rows = numbered.mapInArrow(pairs, BLOCK).repartition(places, "part").mapInArrow(add_up, BLOCK)
    return rows.repartition(GROUPS, "part").mapInArrow(gather, "word int, others binary, counts binary")


def _by_class(batch: pa.RecordBatch, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch of ``neighbours``, and the counts of the classes to the left and to the right of each."""
    words = batch.column("word").to_numpy(zero_copy_only=False).astype(np.int64)
    left, right = np.zeros((len(words), ALL)), np.zeros((len(words), ALL))
    for k, (others, n) in enumerate(zip(batch.column("others"), batch.column("counts"), strict=True)):
        other, count = np.frombuffer(others.as_py(), "<i4"), np.frombuffer(n.as_py(), "<i8")
        side = other & 1 == 1
        right[k] = np.bincount(classes[other[side] >> 1], count[side], ALL)
        left[k] = np.bincount(classes[other[~side] >> 1], count[~side], ALL)
    return words, left, right


def likeliest(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, current: np.ndarray) -> np.ndarray:
    """The class under which the neighbours of each word are likeliest; ``current``: its class by now, which counts it already, or -1."""
    follows = np.log((pairs + PRIOR) / (pairs.sum(1, keepdims=True) + PRIOR * ALL))
    total = right.sum(1)
    grown = np.maximum(pairs.sum(1), 1.0) + np.where(np.arange(ALL) == current[:, None], 0, total[:, None])
    gain = right @ follows.T + left @ follows - total[:, None] * np.log(np.maximum(grown, 1.0))
    return np.argmax(gain[:, :CLASSES], axis=1)


def class_pairs(table: DataFrame, assigned: np.ndarray) -> np.ndarray:
    """Counts of two classes in a row of which one is of a head word."""
    sent = table.sparkSession.sparkContext.broadcast(np.concatenate([assigned, CLASSES + np.arange(SHAPES), [LAST]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = sent.value, np.zeros((ALL, ALL))
        for batch in batches:
            words, left, right = _by_class(batch, classes)
            # A pair of two head words is seen from its left word, any other from its head word.
            np.add.at(seen, classes[words], right)
            for k, c in enumerate(classes[words]):
                seen[CLASSES:, c] += left[k, CLASSES:]
        yield _batch("seen", pa.array([seen.tobytes()], pa.binary()))

    # A table of class pairs per task, of which there are 64 at most.
    found = table.coalesce(64).mapInArrow(run, "seen binary").collect()
    return sum((np.frombuffer(r.seen).reshape(ALL, ALL) for r in found), np.zeros((ALL, ALL)))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the mean log likelihood of a pair that depends on the classes."""

    def part(n: np.ndarray) -> float:
        return float((n * np.log(np.maximum(n, 1.0))).sum())

    return (part(pairs) - part(pairs.sum(0)) - part(pairs.sum(1))) / max(pairs.sum(), 1.0)


def moves(table: DataFrame, assigned: np.ndarray, pairs: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Classes after every ``parts``-th word, from ``part`` on, has moved."""
    classes = np.concatenate([assigned, CLASSES + np.arange(SHAPES), [LAST]])
    sent = table.sparkSession.sparkContext.broadcast((classes, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, pairs = sent.value
        for batch in batches:
            words, left, right = _by_class(batch, classes)
            best = likeliest(left, right, pairs, classes[words])
            yield _batch("word class", pa.array(words, pa.int32()), pa.array(best, pa.int32()))

    out = assigned.copy()
    asked = table.where(F.col("word") % parts == part)
    for r in asked.coalesce(64).mapInArrow(run, "word int, class int").collect():  # a row per head word
        out[r.word] = r["class"]
    return out


def exchange(table: DataFrame, head: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each head word, and the pairs of classes. ``table`` is that of ``neighbours``, written."""
    assigned = np.arange(head) % CLASSES
    pairs = class_pairs(table, assigned)
    value, parts, before = likelihood(pairs), 2, math.inf
    for step in range(steps):
        moved = moves(table, assigned, pairs, step % parts, parts)
        found = class_pairs(table, moved)
        rise = likelihood(found) - value
        if rise < 0:
            parts, rise = 2 * parts, 0.0
        else:
            assigned, pairs, value = moved, found, value + rise
        if before + rise < RISE:
            break
        before = rise
    return assigned, pairs


def join_classes(numbered: DataFrame, classes: np.ndarray, joining: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """``classes`` by symbol, with the likeliest class for the symbols marked in ``joining``.

    A word sends at most 2 * ALL counts from a task, so no word is hot.
    """
    sent = numbered.sparkSession.sparkContext.broadcast((classes, joining, pairs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, joining, _ = sent.value
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return _grouped(keys // (2 * ALL) % GROUPS, keys, n)

        for batch in batches:
            for ids in _ids(batch):
                at = np.flatnonzero(joining[ids])  # never the end, so there is always a next
                if len(at):
                    of, word = classes[ids], ids[at].astype(np.int64) * (2 * ALL)
                    held += [word + np.append(LAST, of[:-1])[at], word + ALL + of[at + 1]]
                    size += 2 * len(at)
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(batches)
        words, starts = np.unique(keys // (2 * ALL), return_index=True)
        ends = np.append(starts[1:], len(keys))
        for a in range(0, len(words), 4096):
            part = slice(starts[a], ends[min(a + 4096, len(words)) - 1])
            some = words[a : a + 4096]
            sides = np.zeros((len(some), 2 * ALL))
            sides[np.searchsorted(some, keys[part] // (2 * ALL)), keys[part] % (2 * ALL)] = counts[part]
            best = likeliest(sides[:, :ALL], sides[:, ALL:], sent.value[2], np.full(len(some), -1))
            yield _batch("word class", pa.array(some, pa.int32()), pa.array(best, pa.int32()))

    met = numbered.mapInArrow(count, BLOCK).repartition(GROUPS, "part").mapInArrow(choose, "word int, class int")
    found, out = met.toArrow(), classes.copy()  # a row per word that was sent
    out[found["word"].to_numpy()] = found["class"].to_numpy()
    return out


def class_trigrams(numbered: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of three classes in a row; two ends come before each text."""
    sent = numbered.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ALL**3, np.int64)
        for batch in batches:
            keys = []
            for ids in _ids(batch):
                c = np.concatenate([[LAST, LAST], sent.value[ids]])
                keys.append((c[:-2] * ALL + c[1:-1]) * ALL + c[2:])
            if keys:
                counts += np.bincount(np.concatenate(keys), minlength=ALL**3)
        at = np.flatnonzero(counts)
        yield _batch("at n", pa.array(at, pa.int32()), pa.array(counts[at], pa.int64()))

    rows = numbered.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ALL**3)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()  # at most ALL ** 3 rows
    return out.reshape(ALL, ALL, ALL)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | two classes before), Witten-Bell."""
    single = counts.sum((0, 1))
    lower = (single + 1) / (single.sum() + ALL)
    for table in (counts.sum(0), counts):
        kinds = (table > 0).sum(-1, keepdims=True)
        total = table.sum(-1, keepdims=True)
        mixed = (table + kinds * lower) / np.maximum(total + kinds, 1)
        lower = np.where(total > 0, mixed, np.broadcast_to(lower, table.shape))
    return np.log10(lower)


@dataclass
class Model:
    known: Words
    head: int
    classes: np.ndarray  # by symbol
    transitions: np.ndarray  # log10, (before, before, class)
    class_tokens: np.ndarray  # training tokens by class
    class_types: np.ndarray  # known words by class
    tokens: int
    types: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + PRIOR) / (self.tokens + PRIOR * (self.types + 1)))

    def emissions(self) -> np.ndarray:
        """log10 P(word | class) of the words that are sent."""
        counts = self.known.counts.astype(np.float64)
        of = self.classes[: len(counts)]
        spelled = (of >= CLASSES) & (of < LAST)
        return np.log10((counts - DISCOUNT * spelled) / np.maximum(self.class_tokens[of], 1))

    def spelled(self) -> tuple[list[float], list[float]]:
        """By shape: log10 of the tokens of the class, and log10 P(unknown word | class)."""
        n, kinds = (x[CLASSES:LAST].astype(np.float64) for x in (self.class_tokens, self.class_types))
        unknown = np.where(n > 0, DISCOUNT * kinds / np.maximum(n, 1), 1.0)
        return np.log10(np.maximum(n, 1)).tolist(), np.log10(unknown).tolist()


def fit(texts: DataFrame, counts: DataFrame, head: int = HEAD, kept: int = KEPT) -> Model:
    """The model of ``texts`` (text) with their word ``counts``, a written table."""
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    short = counts.where(F.octet_length("word") <= LONGEST)
    top = short.orderBy(F.desc("c"), "word").limit(kept).toArrow()  # bounded: ``kept`` words of ``LONGEST`` bytes
    known = Words(uuid.uuid4().hex, [w.encode() for w in top["word"].to_pylist()], top["c"].to_numpy().astype(np.int64))
    head = min(head, len(known.words))
    numbered = written(number(texts, known), "numbered")
    classes = spellings(known)
    table = written(neighbours(numbered, classes, head), "neighbours")
    assigned, pairs = exchange(table, head)
    end = classes == LAST
    classes[:head] = assigned
    classes[end] = LAST
    joining = np.append((known.counts >= SEEN) & (np.arange(len(known.words)) >= head), np.zeros(SHAPES, bool)) & ~end
    classes = join_classes(numbered, classes, joining, pairs)
    sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps((known, classes)))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = pickle.loads(sent.value)
        symbols = symbols_of(words)
        n, kinds = np.zeros(ALL, np.int64), np.zeros(ALL, np.int64)
        for batch in batches:
            of = classes[symbols.of([w.encode() for w in batch.column("word").to_pylist()])] if batch.num_rows else []
            c = batch.column("c").to_numpy()
            n += np.bincount(of, c, ALL).astype(np.int64) if len(of) else 0
            kinds += np.bincount(of, minlength=ALL) if len(of) else 0
        yield _batch("class n kinds", pa.array(range(ALL), pa.int32()), pa.array(n), pa.array(kinds))

    rows = counts.mapInArrow(by_class, "class int, n bigint, kinds bigint").groupBy("class")
    n, kinds = np.zeros(ALL), np.zeros(ALL)
    for r in rows.agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        n[r["class"]], kinds[r["class"]] = r.n, r.kinds
    transitions = smoothed(class_trigrams(numbered, classes))
    return Model(known, head, classes, transitions, n, kinds, sums.n or 0, sums.v)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all rows of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = pickle.loads(sent.value)
        symbols = symbols_of(m.known)
        first = len(m.known.words)
        base, emitted = (np.append(x, np.zeros(SHAPES)) for x in (m.base(m.known.counts), m.emissions()))
        row = TaskContext.get().partitionId() << 33
        moves = m.transitions.ravel()
        for batch in batches:
            out, ends, tail, shapes = [], [0], [], []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                ids = np.array(symbols.of(words))
                c = np.concatenate([[LAST, LAST], m.classes[ids]])
                moved = moves[(c[:-2] * ALL + c[1:-1]) * ALL + c[2:]].sum()
                rare = np.flatnonzero(ids >= first).tolist()
                tail += [words[k] for k in rare]
                shapes.append(ids[rare] - first)
                ends.append(len(tail))
                out.append((len(ids), len(ids) - len(rare), float(base[ids].sum()), float(moved + emitted[ids].sum())))
            n_tokens, n_known, by_base, by_class = zip(*out, strict=True) if out else ((), (), (), ())
            found = pa.StructArray.from_arrays(
                [pa.array(tail, pa.binary()).cast(pa.string()), pa.array(np.concatenate([*shapes, []]), pa.float64()).cast(pa.int32())],
                names=["word", "shape"],
            )
            yield _batch(
                "row_id doc_id held_out n_tokens n_known base_score score tail",
                pa.array(range(row, row + len(out)), pa.int64()),
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(n_tokens, pa.int64()),
                pa.array(n_known, pa.int64()),
                pa.array(by_base, pa.float64()),
                pa.array(by_class, pa.float64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
            )
            row += len(out)

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = raw(docs, "doc_id", held_out.alias("held_out"))
    scored = written(rows.mapInArrow(run, SCORED), "scored")
    sizes, unknown = (F.array(*map(F.lit, x)) for x in model.spelled())
    tails = scored.select("row_id", F.explode("tail").alias("t")).select("row_id", "t.word", "t.shape")
    joined = tails.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + PRIOR) / F.lit(model.tokens + PRIOR * (model.types + 1)))
    emitted = F.when(c > 0, F.log10(c - DISCOUNT) - F.get(sizes, "shape")).otherwise(F.get(unknown, "shape"))
    sums = joined.groupBy("row_id").agg(
        F.count_if(c > 0).alias("more_known"),
        F.sum(base).alias("more_base"),
        F.sum(emitted).alias("more_score"),
    )
    none = F.lit(0)
    return scored.drop("tail").join(sums, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", none)).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` whose crc32(doc_id as text) modulo 10 is not 0, and score all."""
    texts = raw(docs.where(training(F.col("doc_id"))))
    counts = written(count_words(texts), "word-counts")
    return score(docs, fit(texts, counts), counts)
