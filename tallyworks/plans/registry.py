"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Decorator: register a query (spark, sf_dir) -> DataFrame and the SQL that gives the same rows."""

        def keep(function: Query) -> Query:
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function

        return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, because sums in another order differ in their last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
