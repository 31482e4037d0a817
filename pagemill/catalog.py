"""Named queries over the driver tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_PLANS = ("routing", "documents", "corpus", "evaluation", "monitoring", "labels", "storage", "records")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as the query of its name; sql gives the same rows in DuckDB."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _load() -> None:
    for name in _PLANS:
        importlib.import_module(f"pagemill.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
