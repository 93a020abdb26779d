"""Text expressions with the line, space and word rules of Python strings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character is a letter, a number or "_"; Java's own \w is ASCII only.
WORD = r"[\p{L}\p{N}_]"
# With (?U) Java's \s lacks only the four separators 1C to 1F.
SPACE = r"[\s\x1c-\x1f]"
# Line ends other than "\n".
_OTHER_LINE_ENDS = ["\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]

_WORD_START = f"(?<!{WORD})"
_ANY_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def java_pattern(pattern: str) -> str:
    """Java form of a Python pattern, with Unicode-aware ``\\b``, ``\\w`` and ``\\s``."""

    def boundary(match: re.Match) -> str:
        before, after = pattern[: match.start()], pattern[match.end() :]
        if not before and re.match(r"[a-z0-9_]", literal_start(pattern)):
            return _WORD_START
        if not after and re.search(r"(?<!\\)[a-z0-9_]$", before) and literal_start(pattern):
            return f"(?!{WORD})"
        return _ANY_BOUNDARY

    # Whether "x\w*\b" occurs depends on the x alone.
    pattern = re.sub(r"((?<!\\)[a-z0-9_])\\w\*\\b$", r"\1", pattern)
    out = re.sub(r"\\b", boundary, pattern)
    return out.replace(r"\w", WORD).replace(r"\s", SPACE)


def any_pattern(patterns: list[str]) -> str:
    """One Java alternation that matches where any of the Python patterns does.

    The patterns that begin at a word start share one check for it, behind a look at
    the first letter: most positions of a text fail there.
    """
    translated = [java_pattern(p) for p in patterns]
    words = [t.removeprefix(_WORD_START) for t in translated if t.startswith(_WORD_START)]
    options = [f"(?:{t})" for t in translated if not t.startswith(_WORD_START)]
    if words:
        letters = "".join(sorted({w[0] for w in words}))
        options.append(f"(?=[{letters}]){_WORD_START}(?:{'|'.join(words)})")
    return "(?U)" + "|".join(options)


def literal_start(pattern: str) -> str:
    """Plain text every match of the pattern starts with, "" if none can be told."""
    outside_groups = re.sub(r"\([^()]*\)", "", re.sub(r"\\[()]", "", pattern))
    if "|" in outside_groups:
        return ""
    start = re.match(r"(?:\\b)?((?:[a-z0-9_ -]|\\[().])+)(?![?*{])", pattern)
    return start.group(1).replace("\\", "") if start else ""


def word_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w.encode()) for w in words])


def matches_any(text: Column, content: Column, patterns: list[str]) -> Column:
    """True where a Python pattern of the list matches; ``content`` is the text as bytes.

    Where every pattern starts with plain text, the bytes are first searched for these
    words, which is many times faster than a pattern; only texts that hold one go on.
    """
    found = text.rlike(any_pattern(patterns))
    starts = sorted({literal_start(p) for p in patterns})
    if "" in starts:
        return found
    has_start = F.exists(word_array(starts), lambda w: F.contains(content, w))
    return F.when(has_start, found).otherwise(False)


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+\\z", "")


def has_content(text: Column) -> Column:
    """True where the text holds something other than white space."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def unify_line_ends(text: Column) -> Column:
    """Write every line end as ``\\n``; texts that already do are passed through.

    Searching the bytes for the rare line ends is several times faster than a pattern.
    """
    rare = word_array(_OTHER_LINE_ENDS)
    content = text.cast("binary")
    return F.when(
        F.exists(rare, lambda end: F.contains(content, end)),
        F.regexp_replace(text, f"\r\n|[{''.join(_OTHER_LINE_ENDS)}]", "\n"),
    ).otherwise(text)


def line_count(text: Column) -> Column:
    """Number of lines; a final line end opens no further line."""
    return F.regexp_count(F.concat(F.lit("\n"), unify_line_ends(text)), F.lit(r"\n(?!\z)"))


def line_pieces(text: Column, max_lines: int) -> Column:
    """Array of the consecutive pieces of at most ``max_lines`` lines; empty for no lines.

    Each line is read together with the line end before it, so one pass of a single
    pattern finds the pieces and no array of lines is built. ``chunk_of`` takes off the
    line end a piece begins with.
    """
    if max_lines < 1:
        raise ValueError("max_lines must be at least 1")
    return F.regexp_extract_all(
        F.concat(F.lit("\n"), unify_line_ends(text)),
        F.lit(rf"(?:\n(?!\z)[^\n]*+){{1,{max_lines}}}+"),
        F.lit(0),
    )


def chunk_of(piece: Column) -> Column:
    return F.substr(piece, F.lit(2))


def line_chunks(text: Column, max_lines: int) -> Column:
    """Array of the chunks of a text, for work that stays within the row."""
    return F.transform(line_pieces(text, max_lines), chunk_of)


def first_chars(text: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(text, 1, n)


def hit_count(content: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in the bytes of a text; each counts once.

    Searching bytes gives the same hits as searching UTF-8 strings, in half the time.
    """
    return F.aggregate(
        word_array(keywords), F.lit(0), lambda n, k: n + F.contains(content, k).cast("int")
    )


def decode_utf8_ignore(content: Column) -> Column:
    """UTF-8 bytes to text; bytes outside a valid sequence vanish.

    Valid content, the usual case, is only checked. Otherwise the bytes are seen as
    Latin-1 characters, where one pattern keeps the valid sequences and drops the rest.
    """
    text = content.cast("string")
    sequence = (
        "[\\xC2-\\xDF][\\x80-\\xBF]"
        "|\\xE0[\\xA0-\\xBF][\\x80-\\xBF]"
        "|[\\xE1-\\xEC\\xEE\\xEF][\\x80-\\xBF]{2}"
        "|\\xED[\\x80-\\x9F][\\x80-\\xBF]"
        "|\\xF0[\\x90-\\xBF][\\x80-\\xBF]{2}"
        "|[\\xF1-\\xF3][\\x80-\\xBF]{3}"
        "|\\xF4[\\x80-\\x8F][\\x80-\\xBF]{2}"
    )
    latin = F.decode(content, "ISO-8859-1")
    cleaned = F.regexp_replace(latin, f"({sequence})|[\\x80-\\xFF]", "$1")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.encode(cleaned, "ISO-8859-1").cast("string")
    )


def stable_bucket(key: Column, n: Column | int) -> Column:
    """Evenly spread bucket 0 .. n-1 of a string key, the same in every run and engine."""
    number = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")
    return F.pmod(number, n if isinstance(n, Column) else F.lit(n))


def content_key(*columns: str) -> Column:
    """Identity of a row by its content.

    Each value goes in with its length before it, a NULL as a sign of its own, so no two rows
    with different columns give the same text. Declared as never NULL, so a join on it
    does not first hash every row in a NULL check.
    """

    def field(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.coalesce(F.sha2(F.concat(*map(field, columns)), 256), F.lit(""))
