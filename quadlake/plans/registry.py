"""Queries by name, with their SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name; sql is what gives its rows in another engine."""

    def keep(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key!r} is registered already")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = with_views(sql)
        return f

    return keep
