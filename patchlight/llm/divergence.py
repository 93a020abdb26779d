"""How sources of a language differ from one another and from the language, term by term.

Terms are runs of ASCII letters and of all characters beyond ASCII; only A-Z are lower-cased. A first pass counts the
documents that hold a term, exactly, and keeps the terms of ``MIN_DOCS`` or more documents of a language. The kept terms are dealt
into shards of about ``SHARD`` terms; a task builds a minimal perfect hash for each: a term's bucket has a
displacement under which all terms of the shard fall on different slots, as many as there are terms. The shards are broadcast
with their terms, so a term that is found is compared with the stored one and a strange one is never counted. The second pass
adds each document's terms into dense arrays, one slot a kept term and one array a (language, source).

Broadcasts are bounded: shards go out in rounds of at most ``ROUND_BYTES``, each with its own pass over the texts, so a
vocabulary of any size is counted whole. Pairs of sources are summed up in tiles of one shard and two blocks of at most
``BLOCK`` sources. All shares are whole billionths and all sums are of whole numbers.

Null texts are empty, a null language or source is the empty string. Every row is a document, so a repeated row counts again; ids are
not used. A source without terms takes part with a count of zero for every kept term; a language without kept terms has pairs of value 0.
An empty table gives no rows. Ties in a rank go to the smaller item by UTF-8. Extra columns of any name are ignored. A text is
split whole, in one task; its terms take about 60 bytes each there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm.common import text_of, written
from patchlight.llm.jaccard import mixed

MIN_DOCS = 10
SHARD = 4096
BUCKET = 4
ROUND_BYTES = 64 << 20
HELD_TERMS = 300_000
DENSE_BYTES = 128 << 20
BLOCK = 128
SEED = 42  # the seed of Spark's xxhash64, which deals the terms into shards
PLACES = 20  # bits of a slot's number for its place in the shard
TOP = 10
BILLION = 1_000_000_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)

COUNTED = "lang string, source string, slot bigint, n bigint"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def _texts(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), empty).alias("lang"),
        F.coalesce(F.col("source").cast("string"), empty).alias("source"),
        text_of().cast("binary").alias("text"),
    )


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many of the documents seen a term occurs."""
    held: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            found = pa.array(list(counter), pa.binary()).cast(pa.string())
            langs = pa.repeat(pa.scalar(lang, pa.string()), len(found))
            yield pa.RecordBatch.from_arrays([langs, found, pa.array(counter.values(), pa.int64())], names=["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from rows()
    yield from rows()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` documents of a language."""
    partial = _texts(docs).select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n bigint")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def _place(hashes: np.ndarray, move: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return (mixed(hashes ^ (move.astype(np.uint64) + np.uint64(1)) * _STEP) % np.asarray(n, np.uint64)).astype(np.int64)


def displacements(hashes: np.ndarray) -> np.ndarray | None:
    """The displacement of each bucket under which the hashes take all slots from 0; None if two hashes are equal.

    Large buckets go first; a bucket of one hash takes a free slot, written as -1 - slot.
    """
    n = len(hashes)
    if len(np.unique(hashes)) < n:
        return None
    buckets = -(-n // BUCKET)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    free = np.ones(n, bool)
    moves = np.zeros(buckets, np.int32)
    singles = []
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] == 1:
            singles.append(b)
        if sizes[b] < 2:
            continue
        own = hashes[order[ends[b] - sizes[b] : ends[b]]]
        first, width = 0, 64
        while True:
            tried = _place(own[None, :], np.arange(first, first + width)[:, None], n)
            good = [k for k in np.flatnonzero(free[tried].all(axis=1)) if len(set(tried[k])) == len(own)]
            if good:
                free[tried[good[0]]] = False
                moves[b] = first + good[0]
                break
            first, width = first + width, min(2 * width, 4096)
    for b, slot in zip(singles, np.flatnonzero(free), strict=True):
        moves[b] = -1 - slot
    return moves


def _slots(hashes: np.ndarray, moves: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return np.where(moves < 0, -1 - moves.astype(np.int64), _place(hashes, np.maximum(moves, 0), n))


def _build(table: pa.Table) -> pa.Table:
    """The perfect hash of a shard (lang, shard, term): its seed, displacements and terms in the order of their slots."""
    found = table.column("term").cast(pa.binary()).combine_chunks()
    listed = found.to_pylist()
    seed = SEED
    while True:
        # Mixed again: the terms of a shard have equal hashes by the number of shards.
        hashes = mixed(np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in listed), np.uint64, len(listed)))
        moves = displacements(hashes)
        if moves is not None:
            break
        seed += 1
    n = len(listed)
    order = np.argsort(_slots(hashes, moves[(hashes % np.uint64(len(moves))).astype(np.int64)], n))
    return pa.table(
        {
            "lang": table.column("lang").slice(0, 1),
            "shard": table.column("shard").slice(0, 1),
            "n": pa.array([n], pa.int32()),
            "seed": pa.array([seed], pa.int32()),
            "moves": pa.array([moves.tobytes()], pa.binary()),
            "terms": pa.array([[listed[k] for k in order]], pa.list_(pa.binary())),
            "bytes": pa.array([4 * len(moves) + sum(map(len, listed)) + 8 * n], pa.int64()),
        }
    )


def perfect_hashes(kept: DataFrame) -> DataFrame:
    """One row per shard of the kept terms (lang, term)."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = kept.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"), "term")
    schema = "lang string, shard int, n int, seed int, moves binary, terms array<binary>, bytes bigint"
    # Dealt by both, as a join on the language alone would leave all its shards in one task.
    return dealt.repartition("lang", "shard").groupBy("lang", "shard").applyInArrow(_build, schema)


@dataclass
class Slots:
    """The shards of a language that a round holds, as flat arrays."""

    shards: int  # of the language, in all rounds
    held: np.ndarray  # numbers of the shards of this round, ascending
    first: np.ndarray  # first slot of each, and the end
    seeds: np.ndarray
    buckets: np.ndarray
    bucket_first: np.ndarray
    moves: np.ndarray
    terms: pa.Array

    @classmethod
    def of(cls, rows: list, shards: int) -> Slots:
        rows = sorted(rows, key=lambda r: r.shard)
        moves = [np.frombuffer(r.moves, np.int32) for r in rows]
        sizes = np.array([r.n for r in rows], np.int64)
        buckets = np.array([len(m) for m in moves], np.int64)
        return cls(
            shards,
            np.array([r.shard for r in rows], np.int64),
            np.concatenate([[0], np.cumsum(sizes)]),
            np.array([r.seed for r in rows], np.int64),
            buckets,
            np.cumsum(buckets) - buckets,
            np.concatenate(moves),
            pa.array([bytes(t) for r in rows for t in r.terms], pa.large_binary()),
        )

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """The slot of each term in the order of this round, or -1 for what is not kept (or of another round)."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in wanted), np.uint64, len(wanted))
        shard = np.mod(hashes.view(np.int64), self.shards)
        at = np.minimum(np.searchsorted(self.held, shard), len(self.held) - 1)
        out = np.full(len(wanted), -1, np.int64)
        here = np.flatnonzero(self.held[at] == shard)
        at, hashes = at[here], hashes[here]
        for k in np.flatnonzero(self.seeds[at] != SEED):
            hashes[k] = xxhash.xxh64_intdigest(wanted[here[k]], int(self.seeds[at[k]]))
        hashes = mixed(hashes)
        bucket = (hashes % self.buckets[at].astype(np.uint64)).astype(np.int64)
        moves = self.moves[self.bucket_first[at] + bucket]
        sizes = np.diff(self.first)[at]
        slots = self.first[at] + _slots(hashes, moves, sizes)
        asked = pa.array([wanted[k] for k in here], pa.large_binary())
        same = pc.equal(self.terms.take(pa.array(slots)), asked).to_numpy(zero_copy_only=False).astype(bool)
        out[here[same]] = slots[same]
        return out

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """Slot numbers that hold in all rounds: the shard and the place in it."""
        at = np.searchsorted(self.first, slots, side="right") - 1
        return (self.held[at] << PLACES) | (slots - self.first[at])


def _recount(hashes: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, Slots] = hashes.value
        held: dict[tuple[str, str], Counter] = {}
        dense: dict[tuple[str, str], np.ndarray] = {}

        def settle() -> None:
            for (lang, source), counter in held.items():
                at = slots[lang].find(list(counter))
                known = at >= 0
                if (lang, source) not in dense:
                    dense[lang, source] = np.zeros(slots[lang].first[-1], np.int64)
                dense[lang, source][at[known]] += np.fromiter(counter.values(), np.int64, len(counter))[known]
            held.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), len(used)),
                        pa.repeat(pa.scalar(source, pa.string()), len(used)),
                        pa.array(slots[lang].numbers(used), pa.int64()),
                        pa.array(counts[used]),
                    ],
                    names=["lang", "source", "slot", "n"],
                )
            dense.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
            for lang, source, text in zip(*columns, strict=True):
                if lang not in slots:
                    continue
                held.setdefault((lang, source), Counter()).update(terms(text))
                if sum(map(len, held.values())) > HELD_TERMS:
                    settle()
                    if sum(a.nbytes for a in dense.values()) > DENSE_BYTES:
                        yield from rows()
        settle()
        yield from rows()

    return run


def recount(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(lang, source, slot, n) of every kept term that a source has; ``hashes`` is a written table."""
    spark = docs.sparkSession
    listed = hashes.select("lang", "shard", "bytes").orderBy("lang", "shard").collect()
    shards = Counter(r.lang for r in listed)
    texts = _texts(docs)
    parts, number, size = [], 0, 0
    rounds: list[list] = [[]]
    for row in listed:
        if size + row.bytes > ROUND_BYTES and rounds[-1]:
            rounds.append([])
            size = 0
        rounds[-1].append(row)
        size += row.bytes
    for number, members in enumerate(rounds):
        if not members:
            return spark.createDataFrame([], COUNTED)
        low, high = members[0], members[-1]
        place = F.struct("lang", "shard")
        within = place.between(F.struct(F.lit(low.lang), F.lit(low.shard)), F.struct(F.lit(high.lang), F.lit(high.shard)))
        by_lang: dict[str, list] = {}
        for row in hashes.where(within).collect():
            by_lang.setdefault(row.lang, []).append(row)
        sent = spark.sparkContext.broadcast({lang: Slots.of(rows, shards[lang]) for lang, rows in by_lang.items()})
        parts.append(written(texts.mapInArrow(_recount(sent), COUNTED).groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), f"recount-{number}"))
        sent.destroy()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, term) of the shards."""
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["terms"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(row["lang"], pa.string()), n),
                    pa.array((row["shard"] << PLACES) | np.arange(n, dtype=np.int64)),
                    pa.array(row["terms"], pa.binary()).cast(pa.string()),
                ],
                names=["lang", "slot", "term"],
            )


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), by long division in three steps of 1,000."""
    below = total + 2 * kept
    result, rest = F.lit(0).cast("long"), count + 2
    for _ in range(3):
        rest = rest * 1000
        result = result * 1000 + F.call_function("div", rest, below)
        rest = rest % below
    return result + 1


def _shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    below = total + 2 * kept
    result, rest = np.zeros_like(counts), counts + 2
    for _ in range(3):
        rest = rest * 1000
        result = result * 1000 + rest // below
        rest %= below
    return result + 1


def _tile(table: pa.Table) -> pa.Table:
    """Sums over the terms of a shard for the pairs between two blocks of sources."""
    rows = table.select(["own", "first", "second", "source", "total", "kept", "terms_here"]).to_pylist()
    n = rows[0]["terms_here"]
    counts = np.zeros((len(rows), n), np.int64)
    found = table.column("found").combine_chunks()
    entries = found.flatten()
    owner = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
    counts[owner, entries.field("place").to_numpy(zero_copy_only=False)] = entries.field("n").to_numpy(zero_copy_only=False)
    total = np.array([r["total"] for r in rows], np.int64)
    shares = _shares(counts, total[:, None], rows[0]["kept"]) if n else counts
    one, other, values = [], [], []
    own = np.array([r["own"] for r in rows])
    left = np.flatnonzero(own == rows[0]["first"])
    right = np.flatnonzero(own == rows[0]["second"])
    for k in left:
        against = right[right > k] if rows[0]["first"] == rows[0]["second"] else right
        apart = shares[against] - shares[k]
        value = (apart * apart // np.maximum(shares[against] + shares[k], 1)).sum(axis=1)
        one.extend([rows[k]["source"]] * len(against))
        other.extend(rows[i]["source"] for i in against)
        values.append(value)
    both = np.concatenate(values) if values else np.zeros(0, np.int64)
    lang = pa.repeat(table.column("lang")[0], 2 * len(both))
    return pa.table({"lang": lang, "source": pa.array(one + other, pa.string()), "item": pa.array(other + one, pa.string()), "value": np.concatenate([both, both])})


def diverge(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank for documents (text, lang, source)."""
    kept = written(kept_terms(docs, min_docs), "kept-terms")
    hashes = written(perfect_hashes(kept), "perfect-hashes")
    counts = written(recount(docs, hashes), "recounted")

    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = _texts(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = known.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    by_source = Window.partitionBy("lang")
    groups = groups.withColumn("own", ((F.row_number().over(by_source.orderBy("source")) - 1) / BLOCK).cast("int"))
    groups = written(groups.withColumn("blocks", F.max("own").over(by_source) + 1), "groups")

    shard, place = F.shiftright("slot", PLACES).cast("int"), F.col("slot").bitwiseAND((1 << PLACES) - 1).cast("int")
    found = counts.groupBy("lang", "source", shard.alias("shard")).agg(F.collect_list(F.struct(place.alias("place"), "n")).alias("found"))
    shards = F.greatest(F.ceil(F.col("kept") / SHARD), F.lit(1)).cast("int")
    rows = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    rows = rows.join(hashes.select("lang", "shard", F.col("n").alias("terms_here")), ["lang", "shard"], "left")
    rows = rows.join(found, ["lang", "source", "shard"], "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = rows.select(
        "lang",
        "shard",
        F.least("own", "other").alias("first"),
        F.greatest("own", "other").alias("second"),
        "own",
        "source",
        "total",
        "kept",
        F.coalesce("terms_here", F.lit(0)).alias("terms_here"),
        "found",
    )
    sums = tiles.groupBy("lang", "shard", "first", "second").applyInArrow(_tile, "lang string, source string, item string, value bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    named = hashes.select("lang", "shard", "terms").mapInArrow(_named, "lang string, slot bigint, term string")
    overall = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n_lang"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    p, q = F.col("p"), F.col("q")
    told = (
        counts.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"])
        .join(of_lang, "lang")
        .join(named.join(overall, ["lang", "slot"]), ["lang", "slot"])
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
        .withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("kept")))
        .where(p > q)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    best = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).select(columns).unionByName(best.select(columns))
