"""Collects the queries of every plan module with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .bindings import oracle

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["text_plans", "word_plans", "slice_plans", "signal_plans", "report_plans",
           "table_plans", "score_plans", "lexicon_plans", "stream_plans", "source_plans"]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its DuckDB equivalent."""

    def wrap(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = oracle(sql)
        return fn

    return wrap


def load() -> None:
    for module in MODULES:
        import_module(f"{__package__}.{module}")


def all_queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
