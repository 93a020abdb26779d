"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A suffix array over a corpus orders suffixes by ``LENGTH`` bytes, of which only one fact is needed: whether another suffix
starts with the same ``LENGTH`` bytes. Suffixes are put in buckets by a ``GRAM`` of bytes, named by its hash, and buckets are
refined by the names of later ones. A bucket of one suffix is final: nothing longer repeats there.

1. The initial buckets need only some suffixes: of every ``LENGTH`` bytes in a row the gram of smallest hash is chosen
   (winnowing), so two equal strings choose the same grams. Grams in buckets of one are dropped, and so is
   every suffix that has no other chosen gram.
2. A bucket is refined by what lies around the gram: where all ``LENGTH - GRAM`` bytes before and behind it
   are the same too, every string through the gram is repeated: the gram is certain. A suffix whose own smallest
   gram is certain needs no bucket of its own. Another certain gram that reaches it removes it but does not close it: where
   the suffix occurs elsewhere, that gram may not be chosen.
3. The suffixes that are left, at the edges of repeated passages, are refined to the full ``LENGTH``. A closed suffix may
   equal one that is open elsewhere; its smallest gram is chosen in both places, certain here and open there, so the bucket is
   mixed, and one member of every certain part of a mixed bucket speaks: all suffixes it is the smallest gram of take part.

The rule is exact up to the equality of 64-bit hashes. Strings are judged in texts of distinct content; a text
that occurs twice and has ``LENGTH`` bytes goes whole. Every task first settles what it can by itself and sends one
suffix per bucket on, so a string that a third of all texts share arrives once per task. Suffixes travel in packed
blocks, sorted and compressed.

Null and shorter texts keep all their bytes. Repeated rows are texts of equal content. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from patchlight.llm.common import pack, text_of, unpack, written

LENGTH = 200
GRAM = 100
REACH = LENGTH - GRAM
BLOCK_BYTES = 16 << 20
HELD = 500_000
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

BLOCKS = "bucket int, settled boolean, block binary"

_rng = np.random.default_rng(8_200_100)
_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, n.bit_length()))[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Text:
    """Hashes of any stretch of a text, from running sums."""

    def __init__(self, raw: bytes) -> None:
        self.size = len(raw)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(_VALUES[np.frombuffer(raw, np.uint8)] * powers(_BASE, self.size), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * powers(_INVERSE, self.size + 1)[starts] + (ends - starts).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        """Of every stretch of ``length`` bytes."""
        n = self.size - length + 1
        return mixed((self.sums[length:] - self.sums[:n]) * powers(_INVERSE, n) + np.uint64(length))


def lowest(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The smallest of every ``width`` values in a row."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def chosen(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams that are the smallest of some string; and the smallest of every string."""
    least = lowest(grams, REACH + 1)
    edge = np.zeros(REACH, np.uint64)
    most = lowest(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
    return np.flatnonzero(most == grams), least


def several(order: np.ndarray, names: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """Which rows share their names with a row of another place. ``order`` sorts by names, then places."""
    if not len(order):
        return np.zeros(0, bool)
    change = np.zeros(len(order), bool)
    change[0] = True
    for name in names:
        change[1:] |= name[order][1:] != name[order][:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(order)) - 1
    # Sorted by place, a bucket has one place only where its first and last are equal.
    differs = np.zeros(len(starts), bool)
    for place in places:
        differs |= place[order][starts] != place[order][ends]
    out = np.empty(len(order), bool)
    out[order] = np.repeat(differs, np.diff(np.append(starts, len(order))))
    return out


def _blocks(buckets: np.ndarray, columns: list[np.ndarray], settled: bool) -> list[tuple[int, bool, bytes]]:
    """Rows as one block per bucket, ascending by the first column."""
    order = np.lexsort((columns[0], buckets))
    buckets, columns = buckets[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    ends = np.append(starts[1:], len(buckets))
    return [(int(buckets[a]), settled, pack([c[a:b] for c in columns])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _table(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())],
        names=["bucket", "settled", "block"],
    )


def _tables(rows: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 256):
        yield _table(rows[start : start + 256])


def first_of(order: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
    """One row of every bucket."""
    change = np.zeros(len(order), bool)
    change[:1] = True
    for name in names:
        change[1:] |= name[order][1:] != name[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[change]] = True
    return out


def _chosen_grams(buckets: int):
    """Initial buckets of a task: blocks (name, surroundings, content, place, known), and settled blocks (content, place, known).

    ``known`` has bit 1 where the gram is known to be repeated, bit 2 where its surroundings are, and bit 4
    where its bucket is known to be mixed.
    """

    def settle(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        gram, around, content, place = (np.concatenate([h[k] for h in held]) for k in range(4))
        order = np.lexsort((place, content, around, gram))
        by_gram = np.lexsort((place, content, gram))
        repeated = several(by_gram, [gram], [content, place])
        certain = several(order, [gram, around], [content, place])
        mixed_ = several(order, [gram], [around])
        known = (repeated + 2 * certain + 4 * mixed_).astype(np.uint64)
        lead = first_of(order, [gram, around])
        out = [r for r in _blocks((content[~lead] % buckets).astype(np.int64), [content[~lead], place[~lead], known[~lead]], True)] if (~lead).any() else []
        # Of a repeated gram one row informs other tasks by its name; the rest ask by their surroundings only.
        asks = lead & mixed_ & ~first_of(order, [gram])
        name = np.where(asks, around, gram)
        columns = [c[lead] for c in (name, around, content, place, known)]
        yield from _tables(out + _blocks((columns[0] % np.uint64(buckets)).astype(np.int64), columns, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        done: set[int] = set()
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if len(raw) < LENGTH or name in done:
                    continue
                done.add(name)
                text = Text(raw)
                grams = text.all(GRAM)
                place, _ = chosen(grams)
                around = text.hashes(np.maximum(place - REACH, 0), np.minimum(place + LENGTH, text.size))
                around = mixed(around + mixed(np.minimum(place, REACH).astype(np.uint64)))
                content = np.full(len(place), name, np.int64).view(np.uint64)
                held.append([grams[place], around, content, place.astype(np.uint64)])
                size += len(place)
                if size >= HELD:
                    yield from settle(held)
                    held, size, done = [], 0, set()
        if held:
            yield from settle(held)

    return run


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated grams of all blocks of a bucket, as rows (name, mark): 4 * place, + 1 if certain, + 2 if it speaks."""
    asked: list[list[np.ndarray]] = []

    def rows(content: np.ndarray, place: np.ndarray, certain: np.ndarray, speaks: np.ndarray) -> pa.RecordBatch:
        marks = place.astype(np.int64) * 4 + certain + 2 * speaks
        return pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), pa.array(marks)], names=["name", "mark"])

    for batch in batches:
        for settled, block in zip(batch.column("settled").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if settled:
                content, place, known = unpack(block, 3)
                yield rows(content, place, (known & np.uint64(2)) > 0, np.zeros(len(place), bool))
            else:
                asked.append(unpack(block, 5))
    if asked:
        name, around, content, place, known = (np.concatenate([a[k] for a in asked]) for k in range(5))
        asked.clear()
        order = np.lexsort((place, content, around, name))
        repeated = several(np.lexsort((place, content, name)), [name], [content, place]) | ((known & np.uint64(1)) > 0)
        certain = several(order, [name, around], [content, place]) | ((known & np.uint64(2)) > 0)
        told = np.zeros(len(name), bool)
        told[order] = _any_in_bucket(name[order], ((known & np.uint64(4)) > 0)[order])
        speaks = certain & first_of(order, [name, around]) & (several(order, [name], [around]) | told)
        found = repeated | certain
        yield rows(content[found], place[found], certain[found], speaks[found])


def _any_in_bucket(names: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Whether some row of the same name is flagged; ``names`` is sorted."""
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return np.repeat(np.logical_or.reduceat(flags, starts), np.diff(np.append(starts, len(names))))


def reached(places: np.ndarray, size: int) -> np.ndarray:
    """Which strings go through a gram at one of ``places``, by where they start."""
    steps = np.zeros(size - LENGTH + 2, np.int64)
    np.add.at(steps, np.maximum(places - REACH, 0), 1)
    np.add.at(steps, np.minimum(places, size - LENGTH) + 1, -1)
    return np.cumsum(steps)[:-1] > 0


def led(grams: np.ndarray, least: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which strings have their smallest gram at one of ``places``."""
    alive = np.full(len(grams), NEVER)
    alive[places] = grams[places]
    return lowest(alive, REACH + 1) == least


def _edges(buckets: int):
    """Suffixes that the grams leave open: blocks (name, content, start, known), settled ones (content, start)."""

    def settle(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        name, content, start = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((start, content, name))
        repeated = several(order, [name], [content, start])
        lead = first_of(order, [name])
        out = _blocks((content[~lead] % np.uint64(buckets)).astype(np.int64), [content[~lead], start[~lead]], True) if (~lead).any() else []
        columns = [c[lead] for c in (name, content, start, repeated.astype(np.uint64))]
        yield from _tables(out + _blocks((columns[0] % np.uint64(buckets)).astype(np.int64), columns, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            names = batch.column("name").to_pylist()
            for k, (raw, marks) in enumerate(zip(batch.column("raw").to_pylist(), batch.column("marks").to_pylist(), strict=True)):
                text = Text(raw)
                marks_ = np.array(marks, np.int64)
                place = marks_ >> 2
                grams = text.all(GRAM)
                _, least = chosen(grams)
                # A string goes by its own smallest gram: others that reach it need not be chosen where else it occurs.
                sure = led(grams, least, place[marks_ & 1 > 0])
                open_ = (led(grams, least, place) & ~sure) | led(grams, least, place[marks_ & 2 > 0])
                start = np.flatnonzero(open_)
                if len(start):
                    content = np.full(len(start), names[k], np.int64).view(np.uint64)
                    held.append([text.hashes(start, start + LENGTH), content, start.astype(np.uint64)])
                    size += len(start)
                    if size >= HELD:
                        yield from settle(held)
                        held, size = [], 0
        if held:
            yield from settle(held)

    return run


def _refine_edges(buckets: int):
    """Repeated suffixes of all blocks of a bucket, as blocks (content, start) by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[list[np.ndarray]] = []
        found: list[list[np.ndarray]] = []
        for batch in batches:
            for settled, block in zip(batch.column("settled").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if settled:
                    found.append(unpack(block, 2))
                else:
                    asked.append(unpack(block, 4))
        if asked:
            name, content, start, known = (np.concatenate([a[k] for a in asked]) for k in range(4))
            repeated = several(np.lexsort((start, content, name)), [name], [content, start]) | known.astype(bool)
            found.append([content[repeated], start[repeated]])
        if found:
            content, start = (np.concatenate([f[k] for f in found]) for k in range(2))
            if len(content):
                yield from _tables(_blocks((content % np.uint64(buckets)).astype(np.int64), [content, start], True))

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated suffixes of each content as runs of starts: rows (name, runs), a content once."""
    found = [unpack(block, 2) for batch in batches for block in batch.column("block").to_pylist()]
    if not found:
        return
    content, start = (np.concatenate([f[k] for f in found]) for k in range(2))
    order = np.lexsort((start, content))
    content, start = content[order], start[order].astype(np.int64)
    fresh = np.ones(len(content), bool)
    fresh[1:] = content[1:] != content[:-1]
    breaks = fresh.copy()
    breaks[1:] |= start[1:] > start[:-1] + 1
    first = np.flatnonzero(breaks)
    last = np.append(first[1:], len(content)) - 1
    runs = np.stack([start[first], start[last]], axis=1).astype("<i4")
    heads = np.flatnonzero(fresh[first])
    ends = np.append(heads[1:], len(first))
    names = content[first[heads]].view(np.int64)
    for k in range(0, len(heads), 4096):
        part = zip(heads[k : k + 4096].tolist(), ends[k : k + 4096].tolist(), strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[k : k + 4096]), pa.array([runs[x:y].tobytes() for x, y in part], pa.binary())], names=["name", "runs"]
        )


def removed_spans(size: int, marks: list[int], runs: bytes) -> np.ndarray:
    """(start, end) of the maximal runs of bytes to remove."""
    marks_ = np.array(marks, np.int64)
    sure = np.flatnonzero(np.diff(np.concatenate([[0], reached((marks_ >> 2)[marks_ & 1 > 0], size), [0]]).astype(np.int8)))
    spans = np.concatenate([sure.reshape(-1, 2) - [0, 1], np.frombuffer(runs, "<i4").reshape(-1, 2)]).astype(np.int64)
    steps = np.zeros(size + 2, np.int64)
    np.add.at(steps, spans[:, 0] + 1, 1)
    np.add.at(steps, spans[:, 1] + LENGTH + 1, -1)
    covered = np.append(np.cumsum(steps) > 0, False)
    return np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents, spans, kept = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("content", "raw", "marks", "runs")]
        for content, raw, marks, runs in zip(*columns, strict=True):
            removed = removed_spans(len(raw), marks, runs or b"")
            edges = [0, *removed.ravel().tolist(), len(raw)]
            contents.append(content)
            spans.append([{"start": a, "length": b - a} for a, b in removed.tolist()])
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(contents, pa.binary()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["content", "spans", "kept"]
        )


def keyed(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` as (row, content, raw): the row, the SHA-256 of its text and the text's bytes."""
    raw = text_of().cast("binary")
    return docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(raw, 256)).alias("content"), raw.alias("raw"))


def repeated(rows: DataFrame) -> DataFrame:
    """content, spans and kept bytes of the distinct contents of ``rows`` (content, raw) that hold repeated strings.

    Occurrences in copies of a content do not count here.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("raw").cast("long"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BLOCK_BYTES))
    name = F.conv(F.hex(F.substring("content", 1, 8)), 16, -10).cast("long")
    texts = rows.select(name.alias("name"), "content", "raw")

    grams = texts.select("name", "raw").mapInArrow(_chosen_grams(buckets), BLOCKS).repartition(buckets, "bucket")
    marks = grams.mapInArrow(_refine, "name bigint, mark bigint").groupBy("name").agg(F.collect_set("mark").alias("marks"))
    long_enough = texts.where(F.octet_length("raw") >= LENGTH)
    distinct = long_enough.groupBy("name").agg(F.first("content").alias("content"), F.first("raw").alias("raw"))
    open_texts = written(distinct.join(marks.hint("shuffle_hash"), "name"), "repeating")

    edges = open_texts.select("name", "raw", "marks").mapInArrow(_edges(buckets), BLOCKS).repartition(buckets, "bucket")
    blocks = edges.mapInArrow(_refine_edges(buckets), BLOCKS).repartition(buckets, "bucket")
    runs = blocks.mapInArrow(_runs, "name bigint, runs binary")
    found = open_texts.join(runs.hint("shuffle_hash"), "name", "left").select("content", "raw", "marks", "runs")
    kept = found.mapInArrow(_cut, "content binary, spans array<struct<start: bigint, length: bigint>>, kept binary")
    return written(kept.where(F.size("spans") > 0), "spans")


def copied(rows: DataFrame) -> DataFrame:
    """The contents of at least ``LENGTH`` bytes that occur more than once."""
    long_enough = rows.where(F.octet_length("raw") >= LENGTH)
    return written(long_enough.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content", F.lit(True).alias("copied")), "copied")


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = keyed(docs.select("doc_id", "text"))
    cut = repeated(rows.select("content", "raw")).select(
        "content",
        F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"]).alias("removed"),
        F.size("spans").alias("n"),
        F.sha2("kept", 256).alias("sha"),
    )
    narrow = rows.select("row.doc_id", "content", F.octet_length("raw").cast("long").alias("n_bytes"))
    found = narrow.join(written(cut, "cuts"), "content", "left").join(copied(rows), "content", "left")
    whole = F.coalesce("copied", F.lit(False))
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("sha", F.lower(F.hex("content")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with the texts that are left; n_chars, where there is one, counts their code points.

    Bytes of a character that a cut divides are dropped from the text.
    """
    rows = keyed(docs)
    cut = repeated(rows.select("content", "raw")).select("content", "kept")
    found = rows.drop("raw").join(cut, "content", "left").join(copied(rows), "content", "left")
    known = F.col("row.text")
    left = F.when(F.coalesce("copied", F.lit(False)), F.lit("")).when(F.col("kept").isNotNull(), valid_text(F.col("kept"))).otherwise(known)
    found = found.withColumn("left", left)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("left").alias(c))
        elif c == "n_chars":
            changed = F.coalesce("copied", F.lit(False)) | F.col("kept").isNotNull()
            columns.append(F.when(changed, F.length("left").cast("long")).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return found.select(*columns)


@F.pandas_udf(StringType())
def valid_text(raw):
    return raw.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))
