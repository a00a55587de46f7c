"""Registered queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PLAIN_TYPES = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, floats as DOUBLE, so both engines report the same types."""
    return df.select(
        *(
            F.col(name).cast(PLAIN_TYPES[kind]).alias(name) if kind in PLAIN_TYPES else F.col(name)
            for name, kind in df.dtypes
        )
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its oracle."""

    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf: plain_types(build(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
