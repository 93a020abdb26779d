"""Jaccard similarity join on word shingles by a MinHash LSH forest.

A text is the set of its shingles of five words (all words, where there are fewer). Texts of equal sets are
one class and are compared once. A forest has ``TREES`` prefix tries of ``DEPTH`` MinHash values; two texts
that are close share long prefixes. Classes meet below a node of the shortest prefix at which texts of the threshold similarity
still meet in some trie with the target recall (``level``). Nodes of other trees with the same members are left out.

Below such a node the classes are sorted by their values, which makes the trie, and matched prefixes are shortened from ``DEPTH``
values on, one by one. At each length only what is not settled goes on: classes that are connected already are not compared
again, and two others are compared once, at their longest common prefix. Whole signatures (a byte a value) are compared; texts of
the threshold similarity pass with a probability of 1 - ``MISSED``. So texts that meet in a trie by chance, pages of common boilerplate for one,
make no group. A node of more than ``NODE`` classes is dealt into pairs of blocks.

The connected components of these links hold all pairs to be verified, by exact set intersection; a component of
more than ``BLOCK`` classes is dealt into blocks, and every two blocks meet in some task, which returns counts and
a spanning forest, no pairs. So no task holds more than two blocks, and no link is lost to a cap.

The result has one row per row of the input: the class (smallest id among the documents that links
connect) and the number of links, that is of other documents, copies included, at or above the threshold.
Null texts are empty; a text without words has no shingles, no links and a class of its own. Rows without an id
take part and count as links. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import text_of, written
from patchlight.llm.components import components

SHINGLE = 5
TREES = 24
DEPTH = 8
RECALL = 0.9999
MISSED = 1e-5
NODE = 4096
BLOCK = 512
COLUMNS = 8192
KEPT_WORDS = 500_000
NO_ID = -(1 << 63)

SIGNED = "row_id bigint, doc_id bigint, content binary, shingles int, digest binary, nodes array<bigint>, brief binary"

_known: dict[bytes, int] = {}
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes."""
    words = text.encode().split()
    found = list(map(_known.get, words))
    if None in found:
        if len(_known) > KEPT_WORDS:
            _known.clear()
        for k, value in enumerate(found):
            if value is None:
                found[k] = _known[words[k]] = xxhash.xxh64_intdigest(words[k])
    hashes = np.array(found, np.uint64)
    if not len(hashes):
        return hashes
    width = min(SHINGLE, len(hashes))
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        total = mixed(total * _MIX + hashes[k : len(hashes) - width + 1 + k])
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values, (tree, depth)."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        part = low[start : start + 2048, None] * _FACTORS + _SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return least.reshape(TREES, DEPTH)


def level(threshold: float, recall: float = RECALL) -> int:
    """The longest prefix at which texts of the threshold similarity still meet with the target recall."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def nodes(values: np.ndarray, depth: int) -> np.ndarray:
    """One 64-bit number per tree for the node that a prefix of ``depth`` values leads to."""
    total = np.arange(1, TREES + 1, dtype=np.uint64)
    for k in range(depth):
        total = mixed(total * _MIX + values[:, k].astype(np.uint64))
    return total.view(np.int64)


def brief(values: np.ndarray) -> np.ndarray:
    """A byte of each value; values that differ agree in it once in 256 times."""
    return (values.ravel() * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def least_matches(threshold: float, missed: float = MISSED) -> int:
    """The most equal values to ask for so that texts of the threshold similarity miss them with probability ``missed`` at most."""
    n, total = TREES * DEPTH, 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if total > missed:
            return k
    return n


def connected(briefs: np.ndarray, tree: int, depth: int, least: int) -> np.ndarray:
    """Labels (places in ``briefs``) of the classes below a node: equal where a chain of ``least`` equal values or more connects them."""
    prefix = briefs[:, tree * DEPTH : (tree + 1) * DEPTH]
    order = np.lexsort(prefix.T[::-1])
    values, prefix = briefs[order], prefix[order]
    alike = np.cumprod(prefix[1:] == prefix[:-1], axis=1).sum(axis=1)
    alike = np.concatenate([[-1], alike])
    label = np.arange(len(order))
    child = np.arange(len(order))
    for length in range(DEPTH, depth - 1, -1):
        # Below the shortest prefix all classes are one run: the node itself brought them together.
        starts = np.flatnonzero(alike < length) if length > depth else np.array([0])
        run = np.zeros(len(order), np.int64)
        run[starts] = 1
        run = np.cumsum(run) - 1
        for start, stop in zip(starts, [*starts[1:], len(order)]):
            if stop - start > 1 and (label[start:stop] != label[start]).any():
                _settle(values, label, child, np.arange(start, stop), least)
        child = run
    found = np.empty(len(order), np.int64)
    found[order] = order[label]
    return found


def _settle(values: np.ndarray, label: np.ndarray, child: np.ndarray, run: np.ndarray, least: int) -> None:
    """Connect the classes of a run across its children; connected ones are not compared again."""
    rest, waiting = run, []
    while len(rest):
        if not waiting:
            same = label[rest] == label[rest[0]]
            waiting, rest = rest[same].tolist(), rest[~same]
            continue
        one = waiting.pop()
        others = rest[child[rest] != child[one]]
        near = others[(values[others] == values[one]).sum(axis=1) >= least]
        if len(near):
            reached = np.isin(label[rest], label[near])
            waiting += rest[reached].tolist()
            label[rest[reached]] = label[one]
            rest = rest[~reached]


def _connect(depth: int, least: int):
    """Spanning forests of nodes that arrive one after another."""

    def links(tree: int, ids: list[int], briefs: list[bytes]) -> pa.RecordBatch:
        number = np.array(ids)
        label = connected(np.frombuffer(b"".join(briefs), np.uint8).reshape(len(ids), -1), tree, depth, least)
        joined = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(number[label[joined]]), pa.array(number[joined])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, briefs = None, [], []
        for batch in batches:
            for node, first, second, tree, i, found in zip(
                *(batch.column(c).to_pylist() for c in ("node", "first", "second", "tree", "id", "brief")), strict=True
            ):
                if key != (node, first, second, tree):
                    if len(ids) > 1:
                        yield links(key[3], ids, briefs)
                    key, ids, briefs = (node, first, second, tree), [], []
                ids.append(i)
                briefs.append(found)
        if len(ids) > 1:
            yield links(key[3], ids, briefs)

    return run


def _signed(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, digests, leads, briefs = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                values = signature(found)
                leads.append(nodes(values, depth) if len(found) else [])
                briefs.append(brief(values).tobytes() if len(found) else None)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + n), pa.int64()),
                    batch.column("doc_id"),
                    batch.column("content"),
                    pa.array(counts, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(leads, pa.list_(pa.int64())),
                    pa.array(briefs, pa.binary()),
                ],
                names=["row_id", "doc_id", "content", "shingles", "digest", "nodes", "brief"],
            )
            row += n

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in the place of texts."""
    for batch in batches:
        sets = [shingles(text).tobytes() for text in batch.column("text").to_pylist()]
        kept = [batch.column(c) for c in ("id", "copies", "component", "own", "blocks")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, pa.binary())], names=["id", "copies", "component", "own", "blocks", "set"])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], number[column[kept]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - k * COLUMNS] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _verify(threshold: float):
    """Counts and spanning forests of groups that arrive one after another."""
    above, below = int(round(threshold * 1000)), 1000

    def check(ids: list[int], copies: list[int], owns: list[int], sets: list[bytes], same: bool) -> pa.RecordBatch:
        hashes = [np.frombuffer(s, np.uint64) for s in sets]
        sizes = np.array([len(h) for h in hashes])
        both = common(hashes)
        union = sizes[:, None] + sizes[None, :] - both
        linked = below * both >= above * union
        np.fill_diagonal(linked, False)
        if not same:
            side = np.array(owns)
            linked &= side[:, None] != side[None, :]
        number = np.array(ids)
        label = number.copy()
        while True:
            near = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            lower = np.minimum(label, near)
            if (lower == label).all():
                break
            label = lower
        links = linked @ np.array(copies)
        return pa.RecordBatch.from_arrays(
            [pa.array(number), pa.array(label), pa.array(links.astype(np.int64))], names=["id", "label", "links"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def done() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            ids = list(held)
            columns = list(zip(*held.values(), strict=True))
            return check(ids, list(columns[0]), list(columns[1]), list(columns[2]), key[1] == key[2])

        names = ("component", "first", "second", "id", "copies", "own", "set")
        for batch in batches:
            for component, first, second, i, copies, own, found in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if key != (component, first, second):
                    if out := done():
                        yield out
                    key, held = (component, first, second), {}
                held[i] = (copies, own, found)
        if out := done():
            yield out

    return run


def candidates(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, component) of the classes (id, nodes, brief) that some trie brings together and whose signatures are alike.

    Classes without such a partner are left out.
    """
    met = classes.select("id", F.posexplode("nodes").alias("tree", "node"))
    members = F.bit_xor(F.xxhash64("id")).alias("members")
    shared = met.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), members, F.first("tree").alias("tree"))
    # Nodes of other trees with the same members would repeat the same comparisons.
    one = F.min(F.struct("node", "tree")).alias("one")
    shared = written(
        shared.where("n > 1").groupBy("least", "n", "members").agg(one).select("one.*", F.ceil(F.col("n") / NODE).cast("int").alias("blocks")),
        "nodes",
    )
    found = met.drop("tree").join(shared, "node").join(classes.select("id", "brief"), "id")
    found = found.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "tree", "id", "brief"
    )
    groups = dealt.repartition("node", "first", "second").sortWithinPartitions("node", "first", "second")
    edges = groups.mapInArrow(_connect(level(threshold), least_matches(threshold)), "a bigint, b bigint")
    return components(edges)


def similar(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """row_id, doc_id, content (SHA-256 of the text), class_id, copy_class, n_links and class_no of every row of ``docs`` (doc_id, text).

    ``class_no`` tells classes apart where no document of one has an id; it is null for texts without words.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    texts = texts.withColumn("content", F.unhex(F.sha2("text", 256)))
    rows = written(texts.select("doc_id", "content", "text").mapInArrow(_signed(level(threshold)), SIGNED), "signatures")
    key = F.coalesce("doc_id", F.lit(NO_ID))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct(key.alias("key"), "content")).alias("one"),
        F.min("doc_id").alias("least"),
        F.count("*").alias("copies"),
        F.first("nodes").alias("nodes"),
        F.first("brief").alias("brief"),
    )
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    near = candidates(classes, threshold)

    sizes = near.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = near.join(classes.select("id", "one", "copies"), "id").join(written(sizes, "sizes"), "component")
    members = members.select(
        "id", "component", "copies", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("own"), "one.key", "one.content"
    )
    given = texts.select(key.alias("key"), "content", "text").join(members.hint("shuffle_hash"), ["key", "content"])
    sets = given.select("id", "copies", "component", "own", "blocks", "text").mapInArrow(
        _sets, "id bigint, copies bigint, component bigint, own int, blocks int, set binary"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("id", "copies", "component", "own", "set", other).select(
        "component", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "id", "copies", "own", "set"
    )
    groups = dealt.repartition("component", "first", "second").sortWithinPartitions("component", "first", "second")
    verified = written(groups.mapInArrow(_verify(threshold), "id bigint, label bigint, links bigint"), "verified")

    joined = components(verified.select(F.col("label").alias("a"), F.col("id").alias("b")))
    named = joined.join(classes.select("id", "least"), "id")
    named = joined.join(named.groupBy("component").agg(F.min("least").alias("class_id")), "component")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    result = classes.select("digest", "id", "least", "copies").join(named, "id", "left").join(links, "id", "left")
    result = written(
        result.select(
            "digest",
            F.coalesce("component", "id").alias("class_no"),
            F.col("least").alias("copy_class"),
            F.coalesce("class_id", "least").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "linked",
    )
    known = rows.select("row_id", "doc_id", "content", "digest").join(result, "digest", "left")
    return known.select(
        "row_id",
        "doc_id",
        "content",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_class", "doc_id").alias("copy_class"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "class_no",
    )


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those that have a document of a smaller id (or place) in their class."""
    found = similar(docs, threshold)
    key = F.coalesce("doc_id", F.lit(NO_ID)).alias("key")
    alone = found.where("class_no IS NULL").select(key, "content")
    first = found.where("class_no IS NOT NULL").groupBy("class_no").agg(F.min(F.struct(key, "content")).alias("one"))
    kept = alone.unionByName(first.select("one.*")).distinct()
    packed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.unhex(F.sha2(text_of(), 256)).alias("content"), F.struct("*").alias("row")
    )
    return packed.dropDuplicates(["key", "content"]).join(kept, ["key", "content"], "left_semi").select("row.*")
