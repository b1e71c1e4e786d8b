"""Registry of table queries: a Spark form and, where SQL can say it, the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Parquet tables of one scale folder, opened on first use: `tables.orders`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark = spark
        self._folder = str(folder).rstrip("/")

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} is already registered")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql.strip()
        return function

    return add


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Tables(spark, folder))


def r6(value: Column) -> Column:
    return F.round(value, 6)


def big(value: Column) -> Column:
    return value.cast("bigint")


def text_of(number: Column) -> Column:
    return number.cast("string")
