"""Queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: keep a ``(spark, sf_dir) -> DataFrame`` under ``name``, with its SQL."""

    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return keep
