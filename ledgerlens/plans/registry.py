"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def at_edge(df: DataFrame) -> DataFrame:
    """Exact amounts and ISO dates leave a query as text, so that no client rounds or shifts them."""
    textual = (T.DecimalType, T.DateType)
    return df.select(
        *[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, textual) else F.col(f"`{f.name}`") for f in df.schema]
    )


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name`` with its equivalent SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: at_edge(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
