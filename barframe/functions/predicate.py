"""Predicates on a scalar value: an expression, its column, its zone-map test and its grammar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid_input

#: Least and most of a signed 64-bit integer.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
DISCRETE, RANGED = ("eq", "in"), ("gt", "gte", "lt", "lte", "between")


@dataclass(frozen=True)
class Predicate:
    op: str
    values: tuple[int, ...] = ()
    inclusive: bool = True

    def validated(self) -> Predicate:
        if self.op == "between" and self.values[0] > self.values[1]:
            raise invalid_input(f"between bounds are reversed: {self.values[0]} > {self.values[1]}")
        if any(not LEAST <= v <= MOST for v in self.values):
            raise invalid_input("a value exceeds 64 bits")
        return self

    @property
    def discrete(self) -> bool:
        return self.op in DISCRETE

    @property
    def ranged(self) -> bool:
        return self.op in RANGED

    @property
    def impossible(self) -> bool:
        return self.op == "in" and not self.values

    def column(self, c: Column) -> Column:
        v = [F.lit(x).cast("long") for x in self.values]
        if self.op == "in":
            return c.isin(*self.values)
        if self.op == "not_in":
            return ~c.isin(*self.values)
        if self.op == "between":
            return c.between(*v) if self.inclusive else (c > v[0]) & (c < v[1])
        return {"eq": c.__eq__, "ne": c.__ne__, "gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}[self.op](v[0])

    def may_hold(self, low: int, high: int) -> bool:
        """The same for the least and most value of a chunk, as numbers."""
        v = self.values
        if self.op in DISCRETE:
            return any(low <= x <= high for x in v)
        if self.op == "between":
            return high >= v[0] and low <= v[1]
        return {"gt": lambda: high > v[0], "gte": lambda: high >= v[0], "lt": lambda: low < v[0], "lte": lambda: low <= v[0]}.get(self.op, lambda: True)()

    def may_match(self, low: Column, high: Column) -> Column:
        """Whether a block of values from low to high may hold a match."""
        v = self.values
        holds = lambda x: (low <= x) & (high >= x)
        if self.op == "in":
            found = F.lit(False)
            for x in v:
                found = found | holds(F.lit(x))
            return found
        if self.op == "not_in":
            return F.lit(True) if not v else ~((low == high) & low.isin(*v))
        if self.op == "between":
            return (high >= v[0]) & (low <= v[1]) if self.inclusive else (high > v[0]) & (low < v[1])
        return {"eq": lambda: holds(F.lit(v[0])), "ne": lambda: ~((low == v[0]) & (high == v[0])), "gt": lambda: high > v[0], "gte": lambda: high >= v[0], "lt": lambda: low < v[0], "lte": lambda: low <= v[0]}[self.op]()


def eq(v: int) -> Predicate:
    return Predicate("eq", (v,))


def ne(v: int) -> Predicate:
    return Predicate("ne", (v,))


def gt(v: int) -> Predicate:
    return Predicate("gt", (v,))


def gte(v: int) -> Predicate:
    return Predicate("gte", (v,))


def lt(v: int) -> Predicate:
    return Predicate("lt", (v,))


def lte(v: int) -> Predicate:
    return Predicate("lte", (v,))


def between(low: int, high: int, inclusive: bool = True) -> Predicate:
    return Predicate("between", (low, high), inclusive)


def in_set(*values: int) -> Predicate:
    return Predicate("in", tuple(values))


def not_in_set(*values: int) -> Predicate:
    return Predicate("not_in", tuple(values))


def legacy(op: str, value: int, value2: int | None = None) -> Predicate:
    """The older form (op, value, value2): reversed bounds of between are swapped."""
    if op == "between":
        if value2 is None:
            raise invalid_input("between needs a second value")
        return between(min(value, value2), max(value, value2))
    if op not in ("gt", "gte", "lt", "lte", "eq"):
        raise invalid_input(f"unknown operator {op}")
    return Predicate(op, (value,))


_NAMES = {"in-set": "in", "in": "in", "not-in-set": "not_in", "not-in": "not_in"}


def parse(op: str, text: str = "") -> Predicate:
    """An operator's name and its comma-separated integers."""
    try:
        values = tuple(int(x) for x in text.split(",") if x.strip())
    except ValueError:
        raise invalid_input(f"not a list of integers: {text}") from None
    if op in _NAMES:
        return Predicate(_NAMES[op], values)
    wanted = 2 if op.startswith("between") else 1
    if op not in ("eq", "ne", "gt", "gte", "lt", "lte", "between", "between-exclusive"):
        raise invalid_input(f"unknown predicate {op}")
    if len(values) != wanted:
        raise invalid_input(f"{op} takes {wanted} integers")
    return Predicate(op.removesuffix("-exclusive"), values, not op.endswith("exclusive")).validated()
