"""Registration of queries: each is a function of an Arena, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.arena import SQL, Arena

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: str = ""):
    """Register a query; ``sql`` is its body over the arena's tables, ``extra`` more common table expressions."""

    def put(f: Callable[[Arena], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Arena(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = f"WITH RECURSIVE {SQL}{', ' + extra if extra else ''} {sql}"
        return f

    return put
