"""Registered queries: a name, the Spark form and, where there is one, the SQL form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    covers: str
    query: Query
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(covers: str, sql: str | None = None) -> Callable[[Query], Query]:

    def register(query: Query) -> Query:
        if query.__name__ in CHECKS:
            raise ValueError(f"{query.__name__} is registered twice")
        CHECKS[query.__name__] = Check(covers, query, sql)
        return query

    return register
