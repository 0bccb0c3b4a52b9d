"""Functions that users add: SQL functions, macros, Python functions by row batches, tables and aggregates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terraql.errors import UNDEFINED_FUNCTION, EngineError


def table_function(spark: SparkSession, name: str, arguments: str, returns: str, query: str) -> None:
    """A query with parameters, called by place or by name (``f(a => 1)``); arguments may have defaults."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({returns}) RETURN {query}")


def macro(spark: SparkSession, name: str, arguments: str, returns: str, expression: str) -> None:
    """An expression with parameters, inlined where it is called, so it runs as built-in functions do."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {expression}")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


class External:
    """Registered functions over batches, called by name with constant and column arguments."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable, str]] = {}

    def register(self, name: str, returns: str, function: Callable[..., pd.Series]) -> None:
        self.known[name] = (function, returns)

    def call(self, name: str, *columns):
        if name not in self.known:
            raise EngineError(UNDEFINED_FUNCTION, f"no function {name}")
        function, returns = self.known[name]
        return F.pandas_udf(function, returns)(*columns)


def aggregate(function: Callable[[pd.Series], object], returns: str) -> Callable:
    """An aggregate that needs a group's values together; use built-in aggregates wherever they can say it."""

    def over(values: pd.Series) -> float:
        return function(values)

    return F.pandas_udf(over, returns, F.PandasUDFType.GROUPED_AGG)
