"""Registering queries: a DataFrame function and, where SQL can express it, its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 7


def query(oracle: str | None = None):
    """Register a function under its name; doubles are rounded in the result, as in the oracle."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(function(spark, sf_dir))

        QUERIES[function.__name__] = run
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def tidy(df: DataFrame) -> DataFrame:
    return df.select(
        *((F.round(F.col(f"`{c}`"), DIGITS) + 0.0).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes)
    )


def r(expression: str, name: str) -> str:
    """A rounded output column in the oracle."""
    return f"round({expression}, {DIGITS}) + 0e0 AS {name}"
