"""Series derived from others: a transform of bars, stored as a scalar."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import Key


class DerivedSeries(Protocol):
    output: Key
    lookback: int

    def transform(self, bars: DataFrame) -> DataFrame:
        """(ts, value) of bars that begin lookback rows before the range asked for."""


class CloseMinusOpen:
    """The usual example."""

    lookback = 0

    def __init__(self, output: Key):
        self.output = output

    def transform(self, bars: DataFrame) -> DataFrame:
        return bars.select("ts", (F.col("close") - F.col("open")).alias("value"))


def materialize(store, series: DerivedSeries, source: Key, start: int, end: int) -> dict:
    """Compute a derived series over a range of its source and append it."""
    first = start
    if series.lookback:
        before = store.frame(source, None, start - 1).where(F.col("ts") < start).orderBy(F.desc("ts")).limit(series.lookback).agg(F.min("ts")).first()[0]
        first = start if before is None else before
    values = series.transform(store.between(source, first, end)).where(F.col("ts").between(start, end))
    store.register_scalar(series.output, store.meta(source)["timeframe_ms"])
    return store.append(series.output, values)
