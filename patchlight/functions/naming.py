"""File names and review addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlight import constants as C


def language(filename: Column) -> Column:
    """Language by the text after the last dot of the whole path."""
    table = F.create_map(*[F.lit(x) for pair in C.LANGUAGE_BY_EXTENSION.items() for x in pair])
    extension = F.lower(F.substring_index(filename, ".", -1))
    known = F.when(F.contains(filename, F.lit(".")), F.element_at(table, extension))
    return F.coalesce(known, F.lit(C.UNKNOWN_LANGUAGE))


def pr_owner(url: Column) -> Column:
    return F.regexp_extract(url, C.PR_URL_PATTERN, 1)


def pr_repo(url: Column) -> Column:
    return F.regexp_extract(url, C.PR_URL_PATTERN, 2)


def pr_number(url: Column) -> Column:
    """Number of the pull request, NULL where the address is not one."""
    return F.regexp_extract(url, C.PR_URL_PATTERN, 3).try_cast("bigint")
