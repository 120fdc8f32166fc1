"""Registry of queries and access to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The test tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``f(t)`` under ``name``; ``sql`` computes the same from the tables of the same names."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f

    return register


def day(name: str) -> Column:
    return F.col(name).cast("date")


def whole(name: str) -> Column:
    """A whole number kept as double in the tables."""
    return F.col(name).cast("int")
