"""Live series as Structured Streaming: bars from ticks, late rows by watermark, sequence checks with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = "last long, ts long, seen long"
_OUT = "symbol string, kind string, previous_sequence long, sequence long, ts long, ordinal long"


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of ticks (symbol, ts in milliseconds, price, qty, ordinal); rows later than the watermark are dropped."""
    t = ticks.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    order = F.struct("ts", "ordinal")
    g = t.groupBy("symbol", F.window("at", width).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"))
    return g.select("symbol", F.unix_millis("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def _check(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last, before, seen = state.get if state.exists else (None, None, 0)
    rows = []
    for frame in frames:
        for ts, number in frame.sort_values(["ts", "ordinal"])[["ts", "sequence"]].itertuples(index=False):
            if last is not None and number != last + 1:
                kind = "gap" if number > last else "duplicate" if number == last else "violation"
                rows.append((key[0], kind, last, int(number), int(ts), seen))
            last, before, seen = int(number), int(ts), seen + 1
    if last is not None:
        state.update((last, before, seen))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])


def sequence_faults(ticks: DataFrame) -> DataFrame:
    """Gaps, duplicates and violations as rows arrive; state: the last number of each symbol."""
    return ticks.select("symbol", "ts", "ordinal", "sequence").groupBy("symbol").applyInPandasWithState(_check, _OUT, _STATE, "append", "NoTimeout")
