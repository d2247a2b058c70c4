"""The registry of queries: each has a name, a builder, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LATER: dict[str, Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Registers a query; SQL that needs names defined further down its module is given as a function."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if isinstance(sql, str):
            ORACLES[name] = sql
        elif sql is not None:
            LATER[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results of two engines can be compared by value."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
