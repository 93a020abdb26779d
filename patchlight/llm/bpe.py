"""Byte-level BPE, encoding and decoding, from the vocabulary file alone.

A text is cut at the special strings, then into words by the pattern of byte-level BPE. Each word is merged by
a contiguous rank array: the boundaries of its parts and, beside them, the rank of every adjacent
pair. The lowest rank is found by a scan, its boundary is deleted, and the two neighbouring ranks
are looked up again. Words of more than ``SHORT`` bytes would make the scans quadratic; they go
through a heap of pairs over linked parts, which merges the same pairs in the same order.

Ids of words are kept in a table of bounded size per Python process. A null text is the empty
text, which has no ids and decodes to itself. Rows are independent: repeated rows, rows without an id and
extra columns need no care; an empty table gives no rows. A text is encoded whole, in one task. A file whose settings ask for
anything else than this (a normaliser, another pattern, a prefix space, special strings that take in spaces) is an error.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import text_of

SHORT = 64
KEPT_WORDS = 700_000
NO_RANK = 1 << 60
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes stand for themselves,
    the others follow in order from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(byte): byte for byte in printable}
    others = [byte for byte in range(256) if byte not in set(printable)]
    return letters | {chr(256 + k): byte for k, byte in enumerate(others)}


def unsupported(data: dict) -> list[str]:
    """Settings of a vocabulary file that ask for other ids than this module's."""
    model, cut = data["model"], data.get("pre_tokenizer") or {}
    found = [name for name in ("normalizer", "post_processor") if data.get(name)]
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        found.append("pre_tokenizer")
    if (data.get("decoder") or {}).get("type") != "ByteLevel":
        found.append("decoder")
    if model.get("type", "BPE") != "BPE":
        found.append("type")
    settings = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    found += [name for name in settings if model.get(name)]
    for token in data.get("added_tokens", []):
        found += [name for name in ("single_word", "lstrip", "rstrip") if token.get(name)]
    return found


class BytePairs:
    """Vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        if other := unsupported(data):
            raise ValueError(f"{path}: not plain byte-level BPE: {', '.join(other)}")
        letters = byte_letters()
        model = data["model"]
        self.id_of = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.bytes_of = [b""] * (max([*model["vocab"].values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # A pair of adjacent parts is a number made of their ids; so is what it merges into.
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            first, second = (bytes(letters[c] for c in side) for side in (left, right))
            self.rank[self.id_of[first] << 32 | self.id_of[second]] = rank
            self.merged.append(self.id_of[first + second])
        self.byte_ids = [self.id_of[bytes([byte])] for byte in range(256)]
        self.words = regex.compile(PATTERN)
        strings = sorted(self.special, key=len, reverse=True)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None
        self.known: dict[str, bytes] = {}

    def merge_short(self, word: bytes) -> list[int]:
        """Ids of the parts after all merges, lowest rank first and leftmost among equals.

        ``parts`` are the ids between the boundaries that are left, ``ranks`` those of the pairs that
        each inner boundary divides.
        """
        get, merged = self.rank.get, self.merged
        parts = [self.byte_ids[byte] for byte in word]
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            k = ranks.index(low)
            parts[k] = merged[low]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(parts[k] << 32 | parts[k + 1], NO_RANK)
            if k:
                ranks[k - 1] = get(parts[k - 1] << 32 | parts[k], NO_RANK)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same ids by a heap; entries whose parts have changed are passed over."""
        n, get = len(word), self.rank.get
        parts = [self.byte_ids[byte] for byte in word]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k) for k in range(n - 1) if (r := get(parts[k] << 32 | parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if parts[k] < 0 or j < 0 or get(parts[k] << 32 | parts[j]) != rank:
                continue
            parts[k], parts[j] = self.merged[rank], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (r := get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [part for part in parts if part >= 0]

    def word_ids(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers."""
        raw = word.encode()
        parts = self.merge_short(raw) if len(raw) <= SHORT else self.merge_long(raw)
        ids = array("I", parts).tobytes()
        if len(raw) <= SHORT:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        pieces = self.cuts.split(text) if self.cuts else [text]
        known, out = self.known, []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
                continue
            for word in self.words.findall(piece):
                ids = known.get(word)
                out.append(self.word_ids(word) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@cache
def load(path: str) -> BytePairs:
    return BytePairs(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and decoded text of every row of ``docs`` (doc_id, text)."""
    file = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(file)
        for batch in batches:
            ids = [pairs.encode(text) for text in batch.column("text").to_pylist()]
            decoded = [pairs.decode(row) for row in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(row) // 4 for row in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The result of ``encode_decode`` as digests."""
    return encode_decode(docs, path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
