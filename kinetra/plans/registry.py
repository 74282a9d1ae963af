"""The register of queries: name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql is DuckDB's with the same columns, None where SQL cannot say it."""

    def keep(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(places: int, columns: dict) -> list[Column]:
    return [F.round(c if isinstance(c, Column) else F.col(c), places).alias(k) for k, c in columns.items()]


def r6(**columns) -> list[Column]:
    """Doubles rounded to six places, for comparison across engines."""
    return rounded(6, columns)


def r9(**columns) -> list[Column]:
    """To nine places: for ratios of few values with few digits, which six places would often cut at a tie."""
    return rounded(9, columns)
