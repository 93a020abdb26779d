"""Prompt texts for the external judge and the external comment writer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions.text import first_chars


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate the template around its placeholders; the values may hold any character."""
    parts, rest = [], template
    for name, value in values.items():
        head, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(head), value]
    return F.concat(*parts, F.lit(rest))


def judge_prompt(code: Column, max_chars: int = C.MAX_JUDGE_CHARS) -> Column:
    return _fill(C.JUDGE_PROMPT, {"code": first_chars(code, max_chars)})


def feedback_prompt(category: Column, chunk: Column) -> Column:
    return _fill(C.FEEDBACK_PROMPT, {"category": category, "chunk": chunk})


def category_prompt(category: Column, chunk: Column) -> Column:
    """The prompt variant with its own opening for each category."""
    openings = F.create_map(*[F.lit(x) for pair in C.CATEGORY_PROMPTS.items() for x in pair])
    return F.concat(F.element_at(openings, category), chunk)
