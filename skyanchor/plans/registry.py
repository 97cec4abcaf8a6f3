"""Queries register themselves here by name, with the DuckDB SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def d6(x: str, digits: int = 6) -> str:
    """The same in DuckDB."""
    return f"(round(({x})::DOUBLE, {digits}) + 0.0::DOUBLE)"
