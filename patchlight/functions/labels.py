"""Category expressions: weak labels, keyword heuristic, judge replies, class indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.text import SPACE, WORD, hit_count, let, matches_any


def category_array() -> Column:
    return F.array(*[F.lit(c) for c in C.CATEGORIES])


def is_category(label: Column) -> Column:
    return label.isin(C.CATEGORIES)


def weak_label(
    explanation: Column,
    verdict: Column,
    patterns: dict[str, list[str]] = C.WEAK_LABEL_PATTERNS,
    priority: list[str] = C.WEAK_LABEL_PRIORITY,
) -> Column:
    """Label of a reviewed change from the reviewer's words.

    An approved change is ``ok`` and its text is not looked at. For the others the
    first category in ``priority`` with a matching pattern wins. A missing
    explanation counts as empty.
    """

    def scan(text: Column, content: Column) -> Column:
        label = F.lit(C.DEFAULT_WEAK_LABEL)
        for category in reversed(priority):
            found = matches_any(text, content, patterns[category])
            label = F.when(found, category).otherwise(label)
        return label

    lowered = F.lower(F.coalesce(explanation, F.lit("")))
    label = let(lowered, lambda text: let(text.cast("binary"), lambda content: scan(text, content)))
    return F.when(verdict.eqNullSafe(C.APPROVED), "ok").otherwise(label)


def heuristic_label(
    chunk: Column, keywords: dict[str, list[str]] = C.HEURISTIC_KEYWORDS
) -> Column:
    """Category with the most keyword hits; on a tie the earlier category; none gives ``ok``."""

    def best(content: Column) -> Column:
        scores = [F.struct(F.lit(0).alias("hits"), F.lit(1).alias("rank"), F.lit("ok").alias("category"))]
        for index, category in enumerate(C.CATEGORIES):
            if keywords.get(category):
                scores.append(
                    F.struct(
                        hit_count(content, keywords[category]).alias("hits"),
                        F.lit(-index).alias("rank"),
                        F.lit(category).alias("category"),
                    )
                )
        return F.array_max(F.array(*scores))["category"]

    return let(F.lower(chunk).cast("binary"), best)


def judge_label(reply: Column) -> Column:
    """Category named in a judge reply, NULL if there is none or it is not a known one."""
    word = F.lower(_word_after("LABEL", reply))
    return F.when(is_category(word), word)


def judge_confidence(reply: Column) -> Column:
    """Confidence word of a judge reply that names a category, else NULL; not checked further."""
    word = F.lower(_word_after("CONFIDENCE", reply))
    return F.when(
        judge_label(reply).isNotNull(),
        F.when(word == "", C.UNKNOWN_CONFIDENCE).otherwise(word),
    )


def _word_after(field: str, reply: Column) -> Column:
    return F.regexp_extract(reply, f"(?iU){field}:{SPACE}*({WORD}+)", 1)


def category_index(label: Column) -> Column:
    """0-based class index, NULL for a label outside the domain."""
    position = F.array_position(category_array(), label)
    return F.when(position > 0, (position - 1).cast("int"))


def category_of(index: Column) -> Column:
    return F.get(category_array(), index)


def top_category(probabilities: Column) -> Column:
    """Category of the largest probability, the first one on a tie."""
    position = F.array_position(probabilities, F.array_max(probabilities))
    return F.get(category_array(), (position - 1).cast("int"))


def top_confidence(probabilities: Column) -> Column:
    return F.array_max(probabilities)


def with_fallback(
    category: Column, confidence: Column, chunk: Column, threshold: float
) -> tuple[Column, Column]:
    """Replace results below ``threshold`` by the keyword heuristic, with confidence 0."""
    weak = confidence < F.lit(threshold)
    return (
        F.when(weak, heuristic_label(chunk)).otherwise(category),
        F.when(weak, F.lit(0.0)).otherwise(confidence),
    )
