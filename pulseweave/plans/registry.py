"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return keep


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, small integers widened, for comparison with another engine."""
    out = []
    for c, kind in df.dtypes:
        col = F.col(f"`{c}`")
        out.append((F.round(col, places) + F.lit(0.0) if kind == "double" else col.cast("long") if kind in ("int", "smallint") else col).alias(c))
    return df.select(*out)
