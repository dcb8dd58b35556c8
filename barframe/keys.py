"""Identities of series: (symbol, category, name), with scoped names for derived scalars."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import invalid_input

SCOPE = "@@"
KLINE, TRADE, BBO, BOOK_DELTA = "kline", "trade", "bbo", "book_delta"
TICKS = (TRADE, BBO, BOOK_DELTA)
#: Categories set aside for derived scalars (fixed values).
RESERVED = ("indicator", "feature", "factor", "signal", "portfolio", "risk", "metric")
PORTFOLIO_SYMBOL = "__portfolio__"


class Key(NamedTuple):
    symbol: str
    category: str
    name: str

    def checked(self) -> Key:
        for field, value in zip(self._fields, self, strict=True):
            if not isinstance(value, str) or not value.strip():
                raise invalid_input(f"{field} must not be empty")
        return self


def scoped(timeframe: str, name: str) -> str:
    return f"{timeframe}{SCOPE}{name}"


def unscoped(name: str) -> tuple[str, str] | None:
    """(timeframe, name), split at the first mark; None if there is none."""
    head, mark, tail = name.partition(SCOPE)
    return (head, tail) if mark else None


def unscoped_columns(name: Column) -> tuple[Column, Column]:
    parts = F.split(name, SCOPE, 2)
    return F.get(parts, 0), F.get(parts, 1)


def kline(symbol: str, timeframe: str) -> Key:
    return Key(symbol, KLINE, timeframe)


def derived(category: str, symbol: str, timeframe: str, name: str) -> Key:
    if category not in RESERVED:
        raise invalid_input(f"unknown category {category}")
    return Key(symbol, category, scoped(timeframe, name))


def portfolio(timeframe: str, name: str) -> Key:
    return derived("portfolio", PORTFOLIO_SYMBOL, timeframe, name)


def fnv1a64(data: bytes) -> int:
    """FNV-1a with its published 64-bit offset and prime."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def series_id(key: Key) -> int:
    return fnv1a64(":".join(key).encode())
