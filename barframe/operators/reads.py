"""Reads of series: points, inclusive ranges, latest rows and projections.

A frame holds one or more series with their rows; identity columns are filtered before,
so filters and columns reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import invalid_input
from ..schema import FLOW, OHLCV


def series(df: DataFrame, **identity: str) -> DataFrame:
    for k, v in identity.items():
        df = df.where(F.col(k) == v)
    return df


def at(df: DataFrame, ts: int) -> DataFrame:
    """The row at exactly ts, or none."""
    return df.where(F.col("ts") == ts)


def between(df: DataFrame, start: int, end: int, *ties: str) -> DataFrame:
    """Rows from start to end, both included, in order; none if start > end."""
    if start > end:
        return df.limit(0)
    return df.where(F.col("ts").between(start, end)).orderBy("ts", *ties)


def latest(df: DataFrame, n: int, *ties: str) -> DataFrame:
    """The last n rows of one series, oldest first; only the n rows of each task move."""
    if n < 0:
        raise invalid_input("n must not be negative")
    if n == 0:
        return df.limit(0)
    order = ("ts", *ties)
    return df.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def latest_each(df: DataFrame, n: int, by: list[str], *ties: str) -> DataFrame:
    """The last n rows of every series."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in ("ts", *ties)))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def with_position(df: DataFrame, by: list[str], *ties: str) -> DataFrame:
    """Rows with their 0-based position in their series."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("ts", *ties)) - 1)


def widened(df: DataFrame) -> DataFrame:
    """Bars with flow columns; a series without them has nulls."""
    return df.select("*", *(F.lit(None).cast("long").alias(c) for c in FLOW if c not in df.columns))


def ohlcv(df: DataFrame, *identity: str) -> DataFrame:
    return df.select(*identity, *OHLCV)


def prices(df: DataFrame, *identity: str) -> DataFrame:
    return df.select(*identity, "ts", "open", "high", "low", "close")


def activity(df: DataFrame, *identity: str) -> DataFrame:
    return widened(df).select(*identity, "ts", "volume", *FLOW)


def closes(df: DataFrame, *identity: str) -> DataFrame:
    return df.select(*identity, "ts", "close")
