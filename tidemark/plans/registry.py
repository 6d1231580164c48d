"""Registry that pairs each query with its SQL oracle and the operators it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its own name."""

    def add(fn):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
