"""All queries of the engine with their SQL counterparts, by inventory number."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallystone.plans.views import Views, duck

FLAGSHIP = "flagship_directory"
MODULES = ("scans", "filters", "joining", "grouping", "windowing", "ordering", "sets", "texts", "values", "quality", "rules", "searching", "states")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Views as a query, with its SQL for DuckDB where SQL can express it."""

    def put(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            _SQL[name] = duck(sql)
        return build

    return put


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tallystone.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
