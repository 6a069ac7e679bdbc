"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, for comparison across engines; -0 becomes 0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])
