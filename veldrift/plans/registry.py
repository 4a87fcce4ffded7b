"""Queries with their SQL side by side: both select the same columns and round them alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def table(self, name: str, build: Query, ctes: str, source: str, columns: dict[str, int | None]) -> None:
        """Register ``build`` and ``WITH ctes SELECT columns FROM source``. columns: name to digits to round to, or
        None."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df.select(*[F.col(c) if k is None else F.round(F.col(c).cast("double"), k).alias(c) for c, k in columns.items()])

        picked = ", ".join(f'"{c}"' if k is None else f'round(CAST("{c}" AS DOUBLE), {k}) AS "{c}"' for c, k in columns.items())
        query.__name__ = name
        self.queries[name] = query
        self.sql[name] = (f"WITH {ctes} " if ctes else "") + f"SELECT {picked} FROM {source}"

    def rows_only(self, name: str, build: Query) -> None:
        """Register a query that SQL cannot express."""
        self.queries[name] = build
