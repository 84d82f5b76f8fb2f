"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole input tables.
Column names and types match the oracle SQL (BIGINT ids/counts/labels, DOUBLE measures).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


_loaded = False


def _load():
    global _loaded
    if _loaded:
        return
    _loaded = True
    from .plans import catalog, checks, intake  # noqa: F401  (register on import)
