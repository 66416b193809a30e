"""The registry that every module of queries adds to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *views: str) -> None:
    """Register a query; ``views`` are common table expressions that stand before ``sql``."""
    QUERIES[name] = run
    if sql:
        SQL[name] = ("WITH " + ",\n".join(v.strip() for v in views) + "\n" + sql) if views else sql


def dates_as_text(columns: str, *names: str) -> None:
    """Give the named queries' date columns as text, in both forms, as engines hand out dates in different types."""
    cols = columns.split()
    for name in names:
        QUERIES[name] = lambda s, d, f=QUERIES[name]: f(s, d).withColumns({c: F.col(c).cast("string") for c in cols})
        if name in SQL:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in cols)}) FROM ({SQL[name]})"
