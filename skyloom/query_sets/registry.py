"""The registry: a query is a function of (view, spark, sf_dir), ``view`` giving the fixture tables by name."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(functools.partial(fixtures.view, spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fixtures.oracle(sql)
        return run

    return register


def r(column, digits: int) -> Column:
    """Rounded, without a negative zero: both engines then give the same bits."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)
