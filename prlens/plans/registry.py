"""Query registry: name -> Spark query, and name -> oracle SQL (DuckDB).

Each Spark query is a callable ``(spark, sf_dir) -> DataFrame``.  The oracle
is a SQL string over the driver tables; the ``fx_*`` adapter views it uses
are prepended as CTEs automatically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prlens.plans.fixture_sql import with_fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_fixtures(oracle)
        return fn

    return deco
