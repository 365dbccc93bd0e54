"""Registry of queries and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeworks.plans.inputs import Inputs, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, tables: str = ""):
    """Register ``fn(inputs)``; ``tables`` names the shared SQL tables ``sql`` reads."""
    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))
        run.__name__ = key
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_tables(tables.split(), sql)
        return fn
    return wrap
