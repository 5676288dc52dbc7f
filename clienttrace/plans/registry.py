"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def num(c: Column | str, digits: int = 4) -> Column:
    """A double rounded for comparison.

    The tiny shift moves exact ties (means of cents) off the rounding edge,
    where the order of addition would otherwise decide.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + 1e-9, digits)


def sql_num(expression: str, digits: int = 4) -> str:
    return f"round(({expression})::double + 1e-9, {digits})"
