"""Cost-balanced packing of documents into training sequences.

A document is its token ids and an end id. Documents are dealt round robin into groups of bounded
size; every group is packed by itself, so no task sees more than a group. Whole sequences are cut off the
front of long documents. What remains is taken in descending order of its cost (linear plus
quadratic attention cost) and goes to the sequence of lowest cost that has room for it. A group opens
as many sequences as its tokens need, so what finds no room whole is cut over the room that is left, and the padding of
a group is less than one sequence.

Null and empty texts are a document of the end id alone. Repeated rows are documents of their own,
and ties in cost keep the order of the rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import load_tokenizer, text_of

LENGTH = 2048
END_ID = 1
GROUP_BYTES = 24 << 20
ROW_BYTES = 500  # what a row takes in its group besides its text
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
KEPT_WORDS = 1_000_000
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)

# Texts of these characters alone are their own NFC form, and lower-casing them knows no context.
OTHER = re.compile(r"[^\t\n\r -~¡-ɏ]")


def _signs(kind: str) -> str:
    """The characters of a class among those and their lower-case forms, for a set of a pattern."""
    signs = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0x250)]]
    signs = dict.fromkeys([*signs, *"".join(signs).lower()])
    return "".join(re.escape(c) for c in signs if unicodedata.category(c)[0] == kind)


# The words of the tokenizer's own pattern; letters come first, which no other branch starts with.
WORDS = re.compile(rf"[{_signs('L')}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_signs('N')}]|[^\s{_signs('L')}{_signs('N')}]+")


class WordIds:
    """Ids of whole texts by word_bpe_49k.json, with a table of the words seen, of bounded size.

    The file's words are merged one by one, so a text's ids are those of its words in a row. Texts
    with special strings, or with characters whose normal form needs more than a table, go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.by_word = path == public_tokenizers.path("word_bpe_49k.json")
        closing = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.closes = np.zeros(1 << 16, bool)
        self.closes[[i for i in closing if i < 1 << 16]] = True
        self.known: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: one call for all, cut after every id that closes a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.kind)
        cuts = np.flatnonzero(self.closes[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the tokenizer does not close its words")
        raw, width = ids.tobytes(), ids.itemsize
        ends = (cuts * width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in encoded]

    def of(self, text: str) -> bytes:
        if not self.by_word or OTHER.search(text) or self.special.search(text):
            return self._library([text])[0]
        words = WORDS.findall(text.lower())
        known = self.known
        ids = list(map(known.get, words))
        holes = [k for k, held in enumerate(ids) if held is None] if None in ids else []
        if holes:
            new = list(dict.fromkeys([words[k] for k in holes]))
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
            known.update(zip(new, self._words(new), strict=True))
            for k in holes:
                ids[k] = known[words[k]]
        return b"".join(ids)


@cache
def load(path: str) -> WordIds:
    return WordIds(path)


def cost(length: np.ndarray) -> np.ndarray:
    return LINEAR * length + QUADRATIC * length.astype(np.float64) ** 2


def pack(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Sequences count from 0. Every token lies in one piece, and offsets have no gaps.
    """
    pieces = []
    sequence = 0
    rest: list[tuple[int, int, int]] = []
    for document, length in enumerate(lengths):
        full = length // capacity
        for k in range(full):
            pieces.append((document, k * capacity, capacity, sequence, 0))
            sequence += 1
        if length % capacity:
            rest.append((document, full * capacity, length % capacity))
    size = np.array([length for _, _, length in rest], np.int64)
    room = np.full(math.ceil(size.sum() / capacity), capacity, np.int64)
    load = np.zeros(len(room), np.float64)
    price = cost(size)
    homeless = []
    for k in np.argsort(-price, kind="stable").tolist():
        document, start, length = rest[k]
        best = int(np.argmin(np.where(room >= length, load, np.inf)))
        if room[best] < length:
            homeless.append((document, start, length))
            continue
        pieces.append((document, start, length, sequence + best, capacity - int(room[best])))
        room[best] -= length
        load[best] += price[k]
    free = [int(k) for k in np.argsort(load, kind="stable") if room[k]][::-1]
    for document, start, length in homeless:
        while length:
            best = free[-1]
            part = min(length, int(room[best]))
            pieces.append((document, start, part, sequence + best, capacity - int(room[best])))
            room[best] -= part
            start, length = start + part, length - part
            if not room[best]:
                free.pop()
    return pieces


def pack_documents(docs: DataFrame, path: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text)."""
    file = path or public_tokenizers.path("word_bpe_49k.json")
    texts = docs.select("doc_id", text_of().alias("text"))
    # A group holds rows as well as bytes; empty texts are rows too.
    size = texts.agg(F.sum(F.octet_length("text").cast("long") + ROW_BYTES)).first()[0] or 0

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(file)
        end = np.array([END_ID], words.kind).tobytes()
        for batch in batches:
            ids = [words.of(text) + end for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = load(file).kind
        group: list[tuple[int | None, np.ndarray]] = []
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                group.append((doc_id, np.frombuffer(ids, kind)))
        first = TaskContext.get().partitionId() << 32
        rows = []
        for document, start, length, sequence, offset in pack([len(ids) for _, ids in group]):
            doc_id, ids = group[document]
            digest = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            rows.append((doc_id, start, length, digest, len(ids), first + sequence, offset))
        if rows:
            names = [field.split()[0] for field in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    groups = max(1, math.ceil(size / group_bytes))
    dealt = texts.mapInArrow(tokens, "doc_id bigint, ids binary").repartition(groups)
    return dealt.mapInArrow(packed, PIECES)
