"""All queries of the core: name -> callable of (session, data directory), and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


for _module in ("text_plans", "stage_plans", "selection_plans", "recall_plans", "stream_plans", "source_plans", "exchange_plans"):
    import_module(f"corpusloom.plans.{_module}")
