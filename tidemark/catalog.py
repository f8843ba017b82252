"""All registered queries of the reference operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query function and the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def load() -> None:
    """Registers the queries of all modules that are there."""
    import importlib
    import pkgutil

    from tidemark import plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"tidemark.plans.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return SQL
