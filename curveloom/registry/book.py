"""Helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries by name with their independent SQL text, where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            def run(spark: SparkSession, folder: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return query(spark, folder)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round the double columns: sums of floats differ between engines in the last bits."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and f.name not in keep else F.col(f.name)
        for f in df.schema.fields
    ])


def r6(expression: str, name: str | None = None) -> str:
    """SQL twin of ``rounded``; the added zero turns a negative zero into zero."""
    rounded_text = f"round({expression}, 6) + 0.0e0"
    return rounded_text if name is None else f"{rounded_text} AS {name}"
