"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can state it."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(function(spark, folder))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def plain(rows: DataFrame) -> DataFrame:
    """Bring columns to types that compare across engines."""
    columns = []
    for field in rows.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            column = F.array_join(column, "|")
        columns.append(column.alias(field.name))
    return rows.select(*columns)


def stamp(column: str) -> str:
    """SQL text of a time in the form that ``plain`` gives it."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
