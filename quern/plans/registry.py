"""Names of all queries, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its name."""

    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _load() -> None:
    from . import documents, governance, retrieval  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _QUERIES.items() if s}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    _load()
    return _QUERIES["vector_topk"][0](spark, folder)
