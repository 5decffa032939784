"""All queries of the library over the given tables, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("scalars", "read_metrics", "joins", "runs", "fact_metrics", "alignments", "kinetics", "columns", "clusters", "tests", "io", "streams")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql is the same in DuckDB's dialect."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"basewell.plans.{name}")


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
