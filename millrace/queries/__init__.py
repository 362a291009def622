"""The registered queries: name -> (callable of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> dict[str, tuple[Query, str | None]]:
    """All queries; the modules register them when they are imported."""
    from millrace.queries import extract, io, joins, layouts, library, maps, relational, scalars, scaling, sinks, store, streams  # noqa: F401

    return REGISTRY
