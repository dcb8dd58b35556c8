"""NumPy delivery: results of reads as structured arrays, and arrays as input of writes."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import invalid_data, invalid_input
from ..functions import predicate as p
from ..keys import Key, kline
from ..operators import reads
from ..schema import KLINE, KLINE_FLOW, MISSING, SCALAR, Family
from .store import Store


def to_array(df: DataFrame) -> np.ndarray:
    """All columns as 64-bit integers; null as the least."""
    table = df.toArrow()
    out = np.empty(table.num_rows, [(c, np.int64) for c in table.column_names])
    for c in table.column_names:
        out[c] = table.column(c).fill_null(MISSING).to_numpy() if table.column(c).null_count else table.column(c).to_numpy()
    return out


class Reader:
    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root, read_only=True)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        self.store.cache.clear()
        self.store.close()

    def _bars(self, kind: str, symbol: str, timeframe: str, start: int, end: int) -> np.ndarray:
        return to_array(getattr(self.store, kind)(kline(symbol, timeframe), start, end))

    def read_kline_range(self, symbol, timeframe, start_ts, end_ts) -> np.ndarray:
        return self._bars("bars", symbol, timeframe, start_ts, end_ts)

    def read_kline_flow_range(self, symbol, timeframe, start_ts, end_ts) -> np.ndarray:
        return self._bars("flow", symbol, timeframe, start_ts, end_ts)

    def read_kline_prices(self, symbol, timeframe, start_ts, end_ts) -> np.ndarray:
        return self._bars("prices", symbol, timeframe, start_ts, end_ts)

    def read_kline_activity(self, symbol, timeframe, start_ts, end_ts) -> np.ndarray:
        return self._bars("activity", symbol, timeframe, start_ts, end_ts)

    def read_kline_latest(self, symbol, timeframe, limit) -> np.ndarray:
        return to_array(self.store.latest(kline(symbol, timeframe), limit).select(*KLINE.columns))

    def read_kline_flow_latest(self, symbol, timeframe, limit) -> np.ndarray:
        return to_array(reads.widened(self.store.latest(kline(symbol, timeframe), limit)))

    def read_scalar_range(self, symbol, timeframe, category, name, start_ts, end_ts) -> np.ndarray:
        return to_array(self.store.between(Key(symbol, category, f"{timeframe}@@{name}"), start_ts, end_ts))

    def query_scalar_predicate(self, symbol, timeframe, category, name, start_ts, end_ts, *, predicate: str, value=None, min=None, max=None, values=None, inclusive: bool = True) -> np.ndarray:
        if predicate == "between":
            if min is None or max is None:
                raise invalid_input("between needs min and max")
            q = p.between(min, max, inclusive)
        elif predicate in ("in", "not-in"):
            q = p.Predicate(predicate.replace("-", "_"), tuple(values or ()))
        else:
            q = p.parse(predicate, "" if value is None else str(value))
        return to_array(self.store.predicate(Key(symbol, category, f"{timeframe}@@{name}"), q, start_ts, end_ts))

    def kline_info(self, symbol, timeframe) -> dict[str, Any]:
        return self.store.meta(kline(symbol, timeframe))

    def scalar_info(self, symbol, timeframe, category, name) -> dict[str, Any]:
        return self.store.meta(Key(symbol, category, f"{timeframe}@@{name}"))


class Writer:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def _frame(self, rows: np.ndarray, family: Family, equal_ts: bool = False) -> DataFrame:
        step = np.diff(rows["ts"])
        if (step < 0).any() or not equal_ts and (step == 0).any():
            raise invalid_data("rows must be sorted by ts")
        cols = [pa.array(np.ascontiguousarray(rows[f.name]), mask=rows[f.name] == MISSING if f.nullable else None) for f in family.schema]
        return self.spark.createDataFrame(pa.Table.from_arrays(cols, family.columns))

    def write_kline_range(self, symbol, timeframe, rows, *, timeframe_ms, price_scale, volume_scale) -> dict[str, Any]:
        return self.store.append(self.store.register_kline(symbol, timeframe, timeframe_ms, price_scale, volume_scale), self._frame(rows, KLINE))

    def write_kline_flow_range(self, symbol, timeframe, rows, *, timeframe_ms, price_scale, volume_scale, quote_scale) -> dict[str, Any]:
        return self.store.append(self.store.register_kline(symbol, timeframe, timeframe_ms, price_scale, volume_scale, quote_scale), self._frame(rows, KLINE_FLOW))

    def write_scalar_range(self, symbol, timeframe, category, name, rows, *, timeframe_ms, equal_ts=False) -> dict[str, Any]:
        return self.store.append(self.store.register_scalar(Key(symbol, category, f"{timeframe}@@{name}"), timeframe_ms, equal_ts), self._frame(rows, SCALAR, equal_ts))
