"""Named queries and their reference SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r6(df, *columns: str):
    """Round the named double columns for comparison across engines."""
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), 6))
    return df


def rs(*columns: str) -> str:
    """The same rounding as SQL select items."""
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)
