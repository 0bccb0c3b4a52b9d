"""Registered queries: what each computes on Spark, and the same in standard SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraql.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables under its name."""

    def add(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            SQL[function.__name__] = sql
        return function

    return add
