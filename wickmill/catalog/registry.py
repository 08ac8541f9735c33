"""Collects the registered queries of the catalog modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickmill.session import configure

QueryFunction = Callable[[SparkSession, str], DataFrame]

MODULES = ("rollups", "coverage", "writes", "events", "assets", "ledgers", "reads", "series", "streams")


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFunction
    sql: str | None


_QUERIES: dict[str, Query] = {}


def naive_times(df: DataFrame) -> DataFrame:
    """UTC times as zone-less times, the type the SQL side returns."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned}) if zoned else df


def query(name: str, sql: str | None = None):
    """Register a query function under a name, with the SQL that gives the same rows."""

    def register(fn: QueryFunction) -> QueryFunction:
        if name in _QUERIES:
            raise ValueError(f"Query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive_times(fn(configure(spark), sf_dir))

        _QUERIES[name] = Query(name, run, sql)
        return fn

    return register


def _load() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"wickmill.catalog.{module}")
    return _QUERIES


def all_queries() -> dict[str, QueryFunction]:
    return {name: q.run for name, q in _load().items()}


def all_oracles() -> dict[str, str]:
    return {name: q.sql for name, q in _load().items() if q.sql is not None}
