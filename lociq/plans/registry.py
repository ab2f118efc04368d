"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, types: dict[str, str] | None = None):
    """Register a query; ``sql`` may use the fixture views, which are put before it. ``types``: of columns that SQL
    would give another type than the query has."""

    def add(f):
        from .fixtures import with_views

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
            if types:
                casts = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in types.items())
                SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({SQL[name]})"
        return f

    return add
