"""Where queries register themselves together with their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.plans.oracle_views import with_views
from quarrylight.sources.corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(corpus) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Corpus], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Corpus(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    """The SQL twin of each query that has one, with the views it needs."""
    return {name: with_views(sql) for name, sql in _SQL.items()}


# The views must be known before any query registers.
from quarrylight.plans import search_views  # noqa: E402,F401
