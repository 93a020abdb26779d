"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine.

Terms are the lower-case words of a text and the beginnings of longer words. All terms of all sampled examples count, of
clean ones too. A text's vector holds its terms, tf-idf weighted, of length one; terms of which the sample says that they come with
the label (the lower bound, Wilson's, of the label's share passes ``PURITY``) weigh up to ``STRESS`` times more.
Terms that no example holds have a part in the length only.

Alike examples lie in one group (at most ``GROUPS``, by their most frequent terms). The terms that many examples of a group hold are its heads, kept
as a matrix; an inverted index holds all other weights by example. Queries are searched in blocks of alike ones: their heads as products of matrices, their other terms
by the index, over all examples, in single precision; the k-th of the sums' block maxima bounds the k best from below, and the examples above it are added up again in
double precision, so the k nearest are exact. Words met lately keep their terms' numbers, and texts met lately (by a 128-bit hash) their answer.

Votes are weighted by cosine; a monotone curve fitted to the leave-one-out votes of every so many-th example (at least
``CALIBRATION`` of them, in the order of their ids) turns them into scores. A text without any term of the examples gets the share of the label among all examples.

The sample is bounded (``EXAMPLES`` labelled rows, the first by a hash of their id), and with it the model that is sent
to all tasks. Null texts are empty. Labels that are null are not used; the ids of labelled rows and of documents
must not be null to meet. Repeated rows are scored alike. Without examples all texts get the score 0.5; an empty table gives no rows. Other
columns are not read. A text is split whole, in one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from patchlight.llm.common import pack, text_of, unpack, written

EXAMPLES = 20_000
BLOCK = 256  # queries of one product of matrices
BLOCKS = 8  # among whose queries alike ones are put together
EXAMPLES_A_BLOCK = 64
GROUPS = 8
GROUPED_BY = 512  # most frequent terms
KEPT_WORDS = 150_000
KEPT_ANSWERS = 4096
HEADS = 0.025  # share of a group's examples from which on a term may be a head of the group
WORTH = 0.005  # postings a query would add up by a head, as a share of the cells it multiplies instead
CELLS = 1 << 26  # of all heads' matrices; beyond it the least frequent heads are searched as other terms are
CLOSE = 1e-4  # more than single precision may lose
NEIGHBOURS = 15
PURITY = 0.5
STRESS = 12.0
CALIBRATION = 2_000
LONGEST_TERM = 40
THRESHOLD = 0.7
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W_]+")
APART = {c: " " for c in range(128) if not chr(c).isalnum()}
_NEAR = StructType().add("example", "long").add("cosine", "double").add("label", "integer")
EVIDENCE = StructType().add("score", "double").add("evidence", ArrayType(_NEAR))


def terms_in(word: str) -> list[str]:
    """A long run of letters counts piece by piece, and beginnings of words carry a mark that no word holds."""
    pieces = [word[at : at + LONGEST_TERM] for at in range(0, len(word), LONGEST_TERM)]
    return pieces + [f"^{word[:size]}" for size in STEMS if len(word) > size]


def words_of(text: str) -> list[str]:
    """The matches of ``WORD`` in the lower-case text."""
    text = text.lower()
    return text.translate(APART).split() if text.isascii() else WORD.findall(text)


def terms_of(text: str) -> Counter:
    """Term frequencies."""
    counts: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for term in terms_in(word):
            counts[term] += n
    return counts


def hashes_of(terms: list[str]) -> np.ndarray:
    """Terms are known by the hash that Spark's xxhash64 gives them too."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode(), 42) for t in terms), np.uint64, len(terms)).view(np.int64)


def places_of(hashes: np.ndarray, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The number of the term of each hash, or -1."""
    if not len(keys):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, place[at], -1).astype(np.int64)


def numbers_of(terms: list[str], keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The number of each term, or -1."""
    return places_of(hashes_of(terms), keys, place)


@dataclass
class Layout:
    """The examples in the order of their groups, as they are searched."""

    order: np.ndarray  # by place: the example
    place: np.ndarray  # by example
    spans: list[slice]  # by group: its places
    column: np.ndarray  # (group, term): column of the head in the group's matrix, or -1; terms behind the last head are left out
    is_head: np.ndarray  # (term, group)
    dense: list[np.ndarray]  # by group: frequencies by (place, head)
    starts: np.ndarray  # by term, into postings
    postings: np.ndarray  # place and frequency, 32 bits each, where the term is no head of the place's group
    norms: np.ndarray  # by place
    room: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.arange(0), np.empty(0, np.int64)))  # used again for each query


@dataclass
class Index:
    """Examples as unit vectors. Terms are numbered by falling number of examples."""

    keys: np.ndarray  # 64-bit hashes of the terms, ascending
    place: np.ndarray  # by key: the number of the term
    scale: np.ndarray  # by term
    unknown: float
    share: float
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray  # by term, into row and count
    row: np.ndarray  # examples, ascending by term
    count: np.ndarray
    group: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))  # by example
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    known: dict[str, bytes] = field(default_factory=dict)  # codes of the terms of words met lately
    scored: dict[bytes, tuple] = field(default_factory=dict)  # answers for texts met lately

    def __post_init__(self) -> None:
        if not len(self.group):
            self.group = self._groups()

    def __getstate__(self) -> dict:
        """As it is sent: postings compressed, nothing that can be computed again."""
        planes = [np.diff(self.row, prepend=self.row.dtype.type(0)), self.count]
        packed = [(p.dtype.str, len(p), pa.compress(p.view(np.uint8).reshape(len(p), p.itemsize).T.tobytes(), "zstd", asbytes=True)) for p in planes]
        kept = {k: v for k, v in self.__dict__.items() if k not in ("row", "count", "norms", "layout", "sent")}
        return kept | {"packed": packed, "known": {}, "scored": {}}

    def __setstate__(self, state: dict) -> None:
        planes = []
        for kind, n, block in state.pop("packed"):
            width = np.dtype(kind).itemsize
            raw = np.frombuffer(pa.decompress(block, n * width, "zstd", asbytes=True), np.uint8)
            planes.append(np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel())
        self.row, self.count = np.cumsum(planes[0], dtype=planes[0].dtype), planes[1]
        self.__dict__ |= state

    def _frequencies(self, at: slice) -> np.ndarray:
        return 1 + np.log(self.count[at], dtype=np.float32)

    def _raw(self, at: slice, first: int, last: int) -> np.ndarray:
        """The weights, not yet of length one, at the postings ``at`` of the terms from first to last."""
        return self._frequencies(at) * np.repeat(self.scale[first:last], np.diff(self.starts[first : last + 1]))

    def _pieces(self) -> Iterator[tuple[int, int, slice]]:
        """Terms from the first number to the last, and where their postings are."""
        first = 0
        while first < len(self.scale):
            last = min(first + (100 if first < 20_000 else 20_000), len(self.scale))  # the first terms have many postings
            yield first, last, slice(int(self.starts[first]), int(self.starts[last]))
            first = last

    @cached_property
    def norms(self) -> np.ndarray:
        """The length of each example."""
        total = np.zeros(len(self.ids))
        for first, last, at in self._pieces():
            total += np.bincount(self.row[at], self._raw(at, first, last) ** 2, len(total))
        return np.sqrt(np.where(total > 0, total, 1.0))

    def settle(self) -> None:
        """Let go what the layout is made from; searches read the layout only."""
        if len(self.row) and self.layout:
            self.row, self.count = self.row[:0].copy(), self.count[:0].copy()

    def _posting(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[term], self.starts[term + 1])
        return self.row[at], self._raw(at, term, term + 1) / self.norms[self.row[at]]

    def shared(self, spark: SparkSession) -> Broadcast:
        """As it is sent to all tasks, once; the curve may change afterwards and is not to be read there."""
        if "sent" not in self.__dict__:
            self.__dict__["sent"] = spark.sparkContext.broadcast(self)
        return self.__dict__["sent"]

    @property
    def rows(self) -> list[np.ndarray]:
        """By term: its examples."""
        return [self._posting(term)[0] for term in range(len(self.scale))]

    @property
    def weights(self) -> list[np.ndarray]:
        return [self._posting(term)[1] for term in range(len(self.scale))]

    def _groups(self) -> np.ndarray:
        """Alike examples by their most frequent terms: a few rounds of k-means by cosine. Only the speed depends on it."""
        n = len(self.ids)
        groups = max(1, min(GROUPS, n // EXAMPLES_A_BLOCK))
        vectors = np.zeros((n, min(GROUPED_BY, len(self.scale))), np.float32)
        for term in range(vectors.shape[1] if groups > 1 else 0):
            rows, weights = self._posting(term)
            vectors[rows, term] = weights
        centres = vectors[np.linspace(0, n - 1, groups).astype(np.int64)] if n else vectors
        nearest = np.zeros(n, np.uint8)
        for _ in range(10 if groups > 1 else 0):
            nearest = (vectors @ centres.T).argmax(1).astype(np.uint8)
            for g in np.unique(nearest).tolist():
                middle = vectors[nearest == g].sum(0)
                centres[g] = middle / (np.linalg.norm(middle) or 1.0)
        return nearest

    @cached_property
    def layout(self) -> Layout:
        n, held = len(self.ids), np.diff(self.starts)
        sizes = np.bincount(self.group, minlength=1)
        order = np.argsort(self.group, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        ends = np.cumsum(sizes)
        spans = [slice(int(end - size), int(end)) for end, size in zip(ends, sizes, strict=True)]

        # Heads: terms of a large enough share of a group, and met by enough queries of a block. Queries are expected to be like the examples.
        most = int(np.searchsorted(-held, -HEADS * sizes[sizes > 0].min(initial=n)))
        shares = np.zeros((most, len(sizes)))
        for first, last, at in self._pieces():
            if first < most:
                term = np.repeat(np.arange(last - first), held[first:last])
                found = np.bincount(term * len(sizes) + self.group[self.row[at]], minlength=(last - first) * len(sizes))
                shares[first:last] = (found.reshape(-1, len(sizes)) / np.maximum(sizes, 1))[: most - first]
        met, blocks = shares @ sizes, (1 - (1 - shares) ** BLOCK) @ sizes
        worth = np.where(shares > HEADS, shares * (met / np.maximum(blocks, 1e-9))[:, None], 0.0)
        falling = np.argsort(-worth, axis=None, kind="stable")[: np.count_nonzero(worth > WORTH)]
        falling = falling[np.cumsum(sizes[falling % len(sizes)]) <= CELLS]
        column = np.full((len(sizes), most), -1, np.int32)
        dense = []
        for g, size in enumerate(sizes.tolist()):
            heads = np.sort(falling[falling % len(sizes) == g] // len(sizes))
            column[g, heads] = np.arange(len(heads))
            dense.append(np.zeros((size, len(heads)), np.float32))

        left, postings = [], []
        for first, last, at in self._pieces():
            row = self.row[at]
            frequency = self._frequencies(at)
            term, where, group = np.repeat(np.arange(first, last), held[first:last]), place[row], self.group[row]
            other = np.ones(len(row), bool)
            if first < most:
                line = np.where(term < most, column[group, np.minimum(term, most - 1)], -1)
                other = line < 0
                for g, span in enumerate(spans):
                    here = (group == g) & ~other
                    dense[g][where[here] - span.start, line[here]] = frequency[here]
            both = np.empty((np.count_nonzero(other), 2), np.int32)
            both[:, 0] = where[other]
            both[:, 1] = frequency[other].view(np.int32)
            postings.append(both.view(np.int64).ravel())
            left.append(np.bincount(term[other] - first, minlength=last - first))
        starts = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *left])))
        postings = np.concatenate([np.zeros(0, np.int64), *postings])
        return Layout(order, place, spans, column, np.ascontiguousarray(column.T >= 0), dense, starts, postings, self.norms[order])

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        numbers = numbers_of(list(counts), self.keys, self.place)
        weights = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        weights *= np.where(numbers < 0, self.unknown, self.scale[numbers]) if len(self.scale) else self.unknown
        found = numbers >= 0
        if not found.any():
            return np.zeros(0, np.int64), np.zeros(0)
        return numbers[found], weights[found] / np.linalg.norm(weights)

    def learn(self, words: list[str]) -> None:
        """Keep a number for each term of the words: the index's own, or one below 0 that tells terms apart which no example holds."""
        terms = list(map(terms_in, words))
        flat = list(chain.from_iterable(terms))
        hashes = hashes_of(flat)
        numbers, order = np.empty(len(flat), np.int64), np.argsort(hashes)
        numbers[order] = places_of(hashes[order], self.keys, self.place)  # in order, near keys are looked up one after another
        packed, at = np.where(numbers < 0, hashes | np.int64(-1 << 63), numbers).tobytes(), 0
        for word, held in zip(words, terms, strict=True):
            self.known[word] = packed[at : at + 8 * len(held)]
            at += 8 * len(held)

    def vector_of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``vector`` of the terms of a text."""
        return self.vectors_of([text])[0]

    def vectors_of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``vector_of`` each text; the codes of the words met lately are kept for the texts that follow."""
        counted = [Counter(words_of(text)) for text in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        self.learn(list(set().union(*counted) - self.known.keys()))
        return [self._vector(counts) for counts in counted]

    def _vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.known.__getitem__, counts))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 3
        terms, at = np.unique(np.frombuffer(b"".join(found), np.int64), return_inverse=True)
        times = np.bincount(at, np.repeat(np.fromiter(counts.values(), np.float64, len(found)), sizes), len(terms))
        first = int(np.searchsorted(terms, 0))
        weights = 1 + np.log(times)
        weights[:first] *= self.unknown
        weights[first:] *= self.scale[terms[first:]]
        return terms[first:], weights[first:] / (np.linalg.norm(weights) or 1.0)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, ties by their number; ``leave`` is passed over."""
        return next(self.all_nearest([(terms, weights)], k, [leave]))

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, leave: list[int]) -> Iterator[list[tuple[float, int]]]:
        """``nearest`` of each of the vectors."""
        found: list[list[tuple[float, int]]] = [[] for _ in vectors]
        # Queries with the heads of the same group come together, by their length.
        alike = np.array([self._group_of(terms, weights) for terms, weights in vectors], np.int64)
        queue = np.lexsort(([len(terms) for terms, _ in vectors], alike)).tolist()
        for first in range(0, len(queue), BLOCK):
            part = queue[first : first + BLOCK]
            # A query's weight by frequency: all but the example's part of a product.
            asked = [(vectors[j][0], vectors[j][1] * self.scale[vectors[j][0]]) for j in part]
            for j, query, by_heads in zip(part, asked, self._by_heads(asked), strict=True):
                found[j] = self._best(*query, by_heads, k, leave[j])
        return iter(found)

    def _group_of(self, terms: np.ndarray, weights: np.ndarray) -> int:
        """The group whose heads weigh most."""
        few = terms < len(self.layout.is_head)
        return int((weights[few] @ self.layout.is_head[terms[few]]).argmax())

    def _by_heads(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(query, place): what the heads of the place's group add to the product, in single precision."""
        layout = self.layout
        out = np.zeros((len(asked), len(self.ids)), np.float32)
        query = np.repeat(np.arange(len(asked)), [len(terms) for terms, _ in asked])
        term, weight = (np.concatenate([a[part] for a in asked]) for part in range(2))
        few = term < layout.column.shape[1]
        query, term, weight = query[few], term[few], weight[few].astype(np.float32)
        for g, (span, dense) in enumerate(zip(layout.spans, layout.dense, strict=True)):
            line = layout.column[g, term]
            here = line >= 0
            queries = np.zeros((len(asked), dense.shape[1]), np.float32)
            queries[query[here], line[here]] = weight[here]
            used = np.flatnonzero(np.bincount(line[here], minlength=dense.shape[1]))
            if 2 * len(used) < dense.shape[1]:
                queries, dense = queries[:, used], dense.take(used, axis=1)
            if len(used):
                out[:, span] = queries @ dense.T
        return out

    def _best(self, terms: np.ndarray, weights: np.ndarray, by_heads: np.ndarray, k: int, leave: int) -> list[tuple[float, int]]:
        layout, n = self.layout, len(by_heads)
        starts, sizes = layout.starts[terms], layout.starts[terms + 1] - layout.starts[terms]
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        if len(at) > len(layout.room[0]):
            layout.room = np.arange(2 * len(at)), np.empty(2 * len(at), np.int64)
        ramp, room = (r[: len(at)] for r in layout.room)
        at += ramp
        both = layout.postings.take(at, mode="clip", out=room).view(np.int32)
        spread = np.repeat(weights, sizes)
        spread *= both[1::2].view(np.float32)
        by_others = np.bincount(both[::2], spread, n)
        about = (by_others + by_heads) / layout.norms
        if leave >= 0:
            about[layout.place[leave]] = -1.0
        # The k-th of the block maxima is not above the k-th of all: no example of the k nearest lies below it.
        tops = np.maximum.reduceat(about, np.arange(0, n, EXAMPLES_A_BLOCK)) if n > k * EXAMPLES_A_BLOCK else about
        reach = np.partition(tops, len(tops) - k)[len(tops) - k] if n > k else 0.0
        some = np.flatnonzero(about >= max(reach - CLOSE, -CLOSE))
        if len(some) > k:
            near = about[some]
            some = some[near >= np.partition(near, len(near) - k)[len(near) - k] - CLOSE]
        exact = by_others[some].astype(np.float64)
        few = terms < layout.column.shape[1]
        terms, weights = terms[few], weights[few]
        group = self.group[layout.order[some]]
        for g in np.unique(group).tolist():
            line, here = layout.column[g, terms], np.flatnonzero(group == g)
            held = np.flatnonzero(line >= 0)
            if len(held):
                theirs = layout.dense[g].take(some[here] - layout.spans[g].start, axis=0).take(line[held], axis=1)
                exact[here] += theirs.astype(np.float64) @ weights[held]
        exact = np.round(exact / layout.norms[some], 9)
        some = layout.order[some]
        some, exact = some[exact > 0], exact[exact > 0]
        return [(float(exact[i]), int(some[i])) for i in np.lexsort((some, -exact))[:k]]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Cosine-weighted share of the label, drawn to the share of all examples by half a vote."""
        total = sum(c for c, _ in near)
        return (sum(c * self.labels[i] for c, i in near) + 0.5 * self.share) / (total + 0.5)

    def scores(self, texts: list[str]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """Score and nearest examples of each text; copies are searched once while the answer is kept."""
        for first in range(0, len(texts), BLOCKS * BLOCK):
            part = texts[first : first + BLOCKS * BLOCK]
            names = [xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")) for text in part]
            if len(self.scored) > KEPT_ANSWERS:
                self.scored.clear()
            new = {name: text for name, text in zip(names, part, strict=True) if name not in self.scored}
            asked = list(new.values())
            vectors = [v for a in range(0, len(asked), BLOCK) for v in self.vectors_of(asked[a : a + BLOCK])]
            found = self.all_nearest(vectors, NEIGHBOURS, [-1] * len(vectors)) if len(self.ids) else ([] for _ in vectors)
            for name, near in zip(new, found, strict=True):
                self.scored[name] = (self.vote(near), near)
            for vote, near in map(self.scored.__getitem__, names):
                yield (float(np.interp(vote, *self.curve)), near) if near else (self.share, [])


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of least squares (pooled neighbours), each smoothed by one half vote either way."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # votes, positives, rows
    for v, y in zip(votes[order], labels[order], strict=True):
        pools.append([v, float(y), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            v2, y2, n2 = pools.pop()
            v1, y1, n1 = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), y1 + y2, n1 + n2])
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def build_index(vocabulary: Vocabulary, vectors: DataFrame) -> Index:
    """The index of the examples ``vectors`` (doc_id, label, terms: packed numbers and counts), a written table."""
    starts, scale = np.append(0, np.cumsum(vocabulary.held_by)).astype(np.int64), vocabulary.scale
    listed = sorted((r.doc_id, r.label) for r in vectors.select("doc_id", "label").toLocalIterator())
    ids, labels = (np.array([e[k] for e in listed], np.int64) for k in range(2))
    share = (labels.sum() + 0.5) / (len(ids) + 1)
    free = starts[:-1].copy()
    row = np.empty(starts[-1], np.min_scalar_type(len(ids)))
    count = np.empty(starts[-1], np.uint32)
    # One example at a time, in the order of their rows; a repeated id has repeated rows.
    for i, r in enumerate(vectors.orderBy("doc_id", "label", "terms").select("terms").toLocalIterator()):
        terms, counts = unpack(bytes(r.terms), 2)
        at = free[terms.astype(np.int64)]
        row[at], count[at] = i, counts
        free[terms.astype(np.int64)] += 1
    count = count.astype(np.min_scalar_type(int(count.max(initial=0))))
    index = Index(vocabulary.keys, vocabulary.place, scale, vocabulary.unknown, float(share), ids, labels, starts, row, count)
    if len(ids) > NEIGHBOURS and 0 < labels.mean() < 1:
        votes = _leave_one_out(index, vectors)
        index.curve = monotone(np.array([v for _, v, _ in votes]), np.array([y for _, _, y in votes]))
    return index


def _leave_one_out(index: Index, vectors: DataFrame) -> list[tuple[int, float, int]]:
    """(number, vote of the others, label) of every so many-th example, ``CALIBRATION`` or more of them, searched in tasks."""
    step = max(1, len(index.ids) // CALIBRATION)
    numbered = vectors.withColumn("number", F.row_number().over(Window.orderBy("doc_id", "label", "terms")) - 1)
    asked = written(numbered.where(F.col("number") % step == 0), "held-out")
    sent = index.shared(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Index = sent.value
        model.settle()
        for batch in batches:
            given = []
            for block in batch.column("terms").to_pylist():
                terms, counts = unpack(block, 2)
                weights = (1 + np.log(counts.astype(np.float64))) * model.scale[terms.astype(np.int64)]
                given.append((terms.astype(np.int64), weights / np.linalg.norm(weights)))
            numbers = batch.column("number").to_pylist()
            votes = [model.vote(near) for near in model.all_nearest(given, NEIGHBOURS, numbers)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(votes, pa.float64()), batch.column("label")], names=["number", "vote", "label"]
            )

    dealt = asked.repartition(max(1, len(index.ids) // step // 64), "number")
    return sorted(tuple(r) for r in dealt.mapInArrow(run, "number bigint, vote double, label int").collect())


def may_learn(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def wilson_low(hits: Column, n: Column, z: float = 1.96) -> Column:
    share = hits / n
    centre = share + z * z / (2 * n)
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Index:
    """Learn from the labelled rows that may be learned from."""
    known = labels.where(may_learn(F.col("doc_id")) & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    # The sample is at most ``examples`` pairs of numbers, which may be sent to all tasks.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [terms_of(text) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            terms = pa.array(chain.from_iterable(held), pa.string()), pa.array(chain.from_iterable(c.values() for c in held), pa.int64())
            counts = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), *terms)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), counts], names=["doc_id", "label", "terms"])

    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    counted = written(texts.mapInArrow(count, "doc_id bigint, label int, terms map<string, bigint>"), "examples")
    if counted.count() > examples:  # where ids repeat in ``docs``
        counted = written(counted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), "examples")
    return build_index(*_vectors(counted))


@dataclass
class Vocabulary:
    """Numbers and weights of the terms, by falling number of examples."""

    keys: np.ndarray
    place: np.ndarray
    held_by: np.ndarray  # by number: examples that hold the term
    scale: np.ndarray
    unknown: float


def _vectors(counted: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Numbers and weights of all terms of ``counted``, and its rows as packed counts.

    The driver sees a hash and two numbers for each term, not the term.
    """
    sampled = counted.count()
    pairs = counted.select("label", F.explode(F.map_keys("terms")).alias("term"))
    by_term = pairs.groupBy("term").agg(F.sum("label").cast("long").alias("hits"), F.count("*").alias("n"))
    low = F.greatest(F.lit(0.0), (wilson_low(F.col("hits"), F.col("n")) - PURITY) / (1 - PURITY))
    # Terms of equal hashes, one pair in many millions, count as one.
    by_hash = by_term.groupBy(F.xxhash64("term").alias("key")).agg(F.sum("n").cast("int").alias("n"), F.max(low).cast("float").alias("low"))
    found = by_hash.toArrow()
    keys, n, low = (found[c].to_numpy() for c in ("key", "n", "low"))
    del found
    order = np.argsort(keys)
    keys, n, low = keys[order], n[order], low[order].astype(np.float64)
    place = np.empty(len(keys), np.int32)
    place[np.argsort(-n, kind="stable")] = np.arange(len(keys))
    held_by, scale = np.empty(len(keys), np.int64), np.empty(len(keys))
    held_by[place], scale[place] = n, (np.log((sampled + 1) / (n + 1)) + 1) * (1 + (STRESS - 1) * low)
    vocabulary = Vocabulary(keys, place, held_by, scale, math.log(sampled + 1) + 1)
    sent = counted.sparkSession.sparkContext.broadcast((keys, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Each term of a batch is hashed once.
            column = batch.column("terms")
            coded = column.keys.dictionary_encode()
            numbers = numbers_of(coded.dictionary.to_pylist(), *sent.value).astype(np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]
            times, ends = column.items.to_numpy(zero_copy_only=False).astype(np.uint64), column.offsets.to_numpy()
            held = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                order = np.argsort(numbers[a:b], kind="stable")
                held.append(pack([numbers[a:b][order], times[a:b][order]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array(held, pa.binary()),
                ],
                names=["doc_id", "label", "terms"],
            )

    vectors = written(counted.mapInArrow(run, "doc_id bigint, label int, terms binary"), "vectors")
    sent.destroy()
    return vocabulary, vectors


def score_rows(docs: DataFrame, index: Index) -> DataFrame:
    """All rows of ``docs`` as ``row``, with score and evidence (the nearest examples)."""
    sent, curve = index.shared(docs.sparkSession), index.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Index = sent.value
        model.settle()
        model.curve = curve
        kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            found = list(model.scores([text or "" for text in batch.column("row").field("text").to_pylist()]))
            evidence = [
                [{"example": int(model.ids[i]), "cosine": c, "label": int(model.labels[i])} for c, i in near]
                for _, near in found
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, kind)],
                names=["row", "score", "evidence"],
            )

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *EVIDENCE.fields]))


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence of every row of ``docs`` (doc_id, text)."""
    return score_rows(docs.select("doc_id", "text"), index).select("row.doc_id", "score", "evidence")
