"""Registered queries: for each name a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where the operator
is expressible in SQL, the DuckDB oracle statement over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load() -> None:
    from longform.catalog import (checks, ledger, outline, parsing, planning, prompts, runs,  # noqa: F401
                                  sources, writing)


def queries() -> dict[str, Query]:
    _load()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    from longform.oracle import with_fixtures
    return {k: with_fixtures(v[1]) for k, v in _REGISTRY.items() if v[1] is not None}
