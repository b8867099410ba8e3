"""Query registry: a Spark plan and, where SQL can say the same, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxon.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits, so that summation order does not show."""
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def query(sql: str | None = None):
    """Register a function of ``Views`` under its name; ``{view}`` in the SQL names a view."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: rounded(build(Views(spark, sf_dir)))
        if sql is not None:
            ORACLES[build.__name__] = with_views(sql)
        return build

    return register


def r(expression: str, name: str) -> str:
    """Rounded and aliased SQL expression."""
    return f"round(CAST({expression} AS DOUBLE), {DIGITS}) AS {name}"
