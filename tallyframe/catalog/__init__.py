"""Named queries over the benchmark tables, each with its SQL cross-check."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CROSS_CHECKS: dict[str, str] = {}

MODULES = ("reconciling", "rules", "profiling", "history", "files")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CROSS_CHECKS[name] = sql
        return fn

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"tallyframe.catalog.{module}")
