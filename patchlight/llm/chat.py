"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\ntext<|im_end|>\n``. All segments of an Arrow batch are laid out at
once: their lengths give cumulative offsets, and headers, escaped contents and tails are scattered
into one buffer, which is the data buffer of the output column.

Control strings inside a text or role are escaped: a ``<``, any number of backslashes and a ``|`` get one
more backslash, so no text can hold ``<|``. Taking one backslash away gives the text back. In roles a
backslash and a line end are escaped first.

The output has one row per turn, in the order of the turns inside a conversation; the
concatenation of its rows is the conversation. So a conversation of any length is never held in
one cell. A null text or role is empty, a null conversation is a conversation of its own (null), turns
without a number come first, and rows of the same turn are ordered by role and text. Repeated rows stay. An empty
table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, TAIL = b"<|im_start|>", b"<|im_end|>", b"<|im_end|>\n"
ESCAPE, UNESCAPE = r"<(\\*)\|", re.compile(r"<(\\*)\\\|")
LOSS_ROLE = "assistant"

SEGMENTS = "conv_id bigint, turn bigint, segment string, loss_start bigint, loss_end bigint"
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, ESCAPE, r"<\1\\|")


def escape_role(roles: pa.Array) -> pa.Array:
    slashed = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(slashed)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: f"<{m[1]}|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its lengths."""
    large = texts.cast(pa.large_string())
    if large.offset:
        large = pa.concat_arrays([large])
    buffers = large.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[: len(large) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def assemble(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """One string per row, its parts in order; and where each part starts in its row.

    ``parts`` are (bytes of all rows, length per row). Every byte is written once, to the place
    that the running sums of the lengths give.
    """
    lengths = np.stack([length for _, length in parts])
    within = np.zeros_like(lengths)
    np.cumsum(lengths[:-1], axis=0, out=within[1:])
    offsets = np.zeros(lengths.shape[1] + 1, np.int64)
    np.cumsum(lengths.sum(axis=0), out=offsets[1:])
    buffer = np.empty(int(offsets[-1]), np.uint8)
    for (data, length), start in zip(parts, within, strict=True):
        first = np.zeros(len(length), np.int64)
        np.cumsum(length[:-1], out=first[1:])
        target = np.repeat(offsets[:-1] + start - first, length)
        target += np.arange(len(target))
        buffer[target] = data
    rows = pa.LargeStringArray.from_buffers(lengths.shape[1], pa.py_buffer(offsets), pa.py_buffer(buffer))
    return rows, within


def _same(value: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(value, np.uint8), rows), np.full(rows, len(value), np.int64)


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formats turns; the loss mask is given as a range of bytes of the segment, empty for other roles."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        roles, texts = batch.column("role"), batch.column("text")
        role, text = _bytes_of(escape_role(roles)), _bytes_of(escape(texts))
        rows, within = assemble([_same(START, n), role, _same(b"\n", n), text, _same(TAIL, n)])
        learn = np.asarray(pc.equal(roles, LOSS_ROLE))
        starts = np.where(learn, within[3], 0)
        ends = np.where(learn, within[4], 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), rows.cast(pa.string()), pa.array(starts), pa.array(ends)],
            names=["conv_id", "turn", "segment", "loss_start", "loss_end"],
        )


def format_chats(turns: DataFrame) -> DataFrame:
    """Segments of all ``turns`` (conv_id, turn, role, text), each conversation in order in one partition.

    The order is that of a sort, so it holds until the next shuffle.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(format_batches, SEGMENTS)


class _Conversation:
    """Running digests of one conversation; holds no text."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, end: int) -> None:
        raw = segment.encode()
        header, _, rest = segment[len(START) :].partition("\n")
        body = rest[: -len(TAIL)]
        if raw[: len(START)] != START or raw[-len(TAIL) :] != TAIL or END.decode() in body:
            raise ValueError("not a formatted turn")
        self.turns += 1
        self.chars += len(segment)
        self.text.update(f"{unescape_role(header)}\n{unescape(body)}\n".encode())
        masked = unescape(raw[start:end].decode())
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current: _Conversation | None = None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")]
        for conv_id, segment, start, end in zip(*columns, strict=True):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Conversation(conv_id)
            current.add(segment, start, end)
        if done:
            yield table(done)
    if current is not None:
        yield table([current.row()])


def chat_digests(segments: DataFrame) -> DataFrame:
    """What the formatted turns hold, read back from them: one row per conversation.

    Takes the output of ``format_chats`` as it is. A digest over a conversation is sequential by its nature,
    so one task goes through its segments; it holds one batch of them at a time.
    """
    return segments.mapInArrow(digest_batches, DIGESTS)
