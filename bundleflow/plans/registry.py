"""Where queries and their check SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import projections as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of ``sql`` (a runner of projections) under its name."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)

            def sql(text: str) -> DataFrame:
                return P.run(spark, sf_dir, text)

            sql.spark, sql.sf_dir = spark, sf_dir
            return fn(sql)

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return add
