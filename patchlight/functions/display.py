"""Expressions of the findings report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.text import first_chars, strip


def percent(confidence: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(confidence * 100 + 0.5).cast("int")


def percent_even(confidence: Column) -> Column:
    """Whole percent, halves to the even number."""
    return F.bround(confidence * 100, 0).cast("int")


def confidence_text(confidence: Column) -> Column:
    return F.when(
        confidence > 0, F.concat(percent_even(confidence).cast("string"), F.lit("% confidence"))
    ).otherwise("heuristic")


def display_name(category: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in C.DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, category), F.lit(C.DISPLAY_NAMES["ok"]))


def code_preview(code: Column, n: int = C.PREVIEW_CHARS) -> Column:
    return F.concat(first_chars(code, n), F.lit("..."))


def plain_feedback(feedback: Column) -> Column:
    """Feedback without Markdown fences and back-ticks."""
    unfenced = F.regexp_replace(F.regexp_replace(feedback, "```[a-z]*\\n?", ""), "```", "")
    return strip(F.regexp_replace(unfenced, "`([^`]+)`", "$1"))


def feedback_or_reason(reply: Column, error: Column) -> Column:
    """Trimmed reply, or a note that says why there is none."""
    reason = F.coalesce(error, F.lit("no reply"))
    return F.coalesce(
        strip(reply), F.concat(F.lit("(feedback unavailable: "), reason, F.lit(")"))
    )
