"""How a query and its SQL twin are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.bindings import bind, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*inputs: str, sql: str | None = None):
    """Register a function of bound frames under its own name; sql is its DuckDB twin."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(bind(spark, sf_dir, n) for n in inputs))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def half_up(x: str, places: int = 2) -> str:
    """DuckDB SQL for rounding half up on the decimal text of a double, as Spark's round does."""
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), {places}) AS DOUBLE)"
