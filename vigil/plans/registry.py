"""Registry of named queries: Spark builder + DuckDB oracle SQL.

Each plan module registers ``name -> (spark_fn(spark, sf_dir) -> DataFrame,
oracle_sql | None)``. ``None`` marks operators without an exact SQL form
(model training, streaming), which the driver checks by row count only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _load() -> None:
    # import for side effects: every module registers its queries
    from vigil.plans import (predict, describe, intervene, validate, ingest,  # noqa: F401
                             layers, regions, learn, streams)


def _utc(fn: QueryFn) -> QueryFn:
    """Pin the session time zone: hour/weekday parts and timestamp casts of
    the naive source timestamps are defined in UTC."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    _load()
    return {k: _utc(v) for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
