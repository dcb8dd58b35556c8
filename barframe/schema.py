"""Record families, their columns and the rules that rows must keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What marks an absent flow value outside, at import and export only.
MISSING = -(1 << 63)
OHLCV = ("ts", "open", "high", "low", "close", "volume")
FLOW = ("quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume")
UNITS = ("month", "day", "hour")
PART_FORMAT = {"month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH"}


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_L = T.LongType()


@dataclass(frozen=True)
class Family:
    name: str
    schema: T.StructType
    schema_id: int
    equal_ts: bool = False
    sequence: str | None = None
    unit: str = "month"

    @property
    def columns(self) -> list[str]:
        return self.schema.names


KLINE = Family("kline", _struct(*((c, _L, False) for c in OHLCV)), 1)
KLINE_FLOW = Family("kline_flow", _struct(*((c, _L, False) for c in OHLCV), *((c, _L, True) for c in FLOW)), 3)
SCALAR = Family("scalar", _struct(("ts", _L, False), ("value", _L, False)), 2)
TRADE = Family("trade", _struct(*((c, _L, False) for c in ("ts", "recv_ts", "trade_id", "price", "qty")), ("side", T.ByteType(), False), ("flags", T.ShortType(), False)), 10, True, "trade_id", "hour")
BBO = Family("bbo", _struct(*((c, _L, False) for c in ("ts", "recv_ts", "bid_price", "bid_qty", "ask_price", "ask_qty", "sequence"))), 11, False, "sequence", "day")
BOOK_DELTA = Family("book_delta", _struct(*((c, _L, False) for c in ("ts", "recv_ts", "sequence", "price", "qty")), ("side", T.ByteType(), False), ("action", T.ByteType(), False), ("level", T.ShortType(), False), ("flags", _L, False)), 12, True, "sequence", "hour")
FAMILIES = {f.name: f for f in (KLINE, KLINE_FLOW, SCALAR, TRADE, BBO, BOOK_DELTA)}


def part_of(ts: Column, unit: str) -> Column:
    """The partition key of an epoch millisecond, in UTC sessions."""
    return F.date_format(F.timestamp_millis(ts), PART_FORMAT[unit])


def from_sentinel(c: str) -> Column:
    return F.when(F.col(c) != F.lit(MISSING), F.col(c)).alias(c)


def to_sentinel(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(MISSING)).alias(c)


def flow_faults() -> Column:
    """True where a flow row breaks a rule."""
    c = F.col
    bad = c("volume") < 0
    for f in FLOW:
        bad = bad | F.coalesce(c(f) < 0, F.lit(False))
    bad = bad | F.coalesce(c("taker_buy_volume") > c("volume"), F.lit(False))
    over = c("quote_volume").isNull() | (c("taker_buy_quote_volume") > c("quote_volume"))
    return bad | (c("taker_buy_quote_volume").isNotNull() & over)
