"""Sort-key conditions as intervals of bytes, and the algebra of intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodekey.functions.keys import KeyError_, encode_key, successor


@dataclass(frozen=True)
class Interval:
    """Keys between two bounds; a bound of None is open."""

    low: bytes | None = None
    low_in: bool = True
    high: bytes | None = None
    high_in: bool = False

    def column(self, sk: Column) -> Column:
        """The predicate, in a form that Parquet can test on its statistics."""
        out = F.lit(True)
        if self.low:
            out = out & ((sk >= F.lit(self.low)) if self.low_in else (sk > F.lit(self.low)))
        elif self.low is not None and not self.low_in:
            out = out & (sk > F.lit(b""))
        if self.high is not None:
            out = out & ((sk <= F.lit(self.high)) if self.high_in else (sk < F.lit(self.high)))
        return out

    def holds(self, key: bytes) -> bool:
        above = self.low is None or key > self.low or (self.low_in and key == self.low)
        below = self.high is None or key < self.high or (self.high_in and key == self.high)
        return above and below


EVERYTHING = Interval()


@dataclass(frozen=True)
class Condition:
    """``op`` is eq, gt, gte, lt, lte, between, begins_with or range.

    ``between`` takes ``value`` and ``other``; ``range`` takes either or both
    with ``low_in`` and ``high_in``.
    """

    op: str
    value: str | bytes | None = None
    other: str | bytes | None = None
    low_in: bool = True
    high_in: bool = False


def _bound(value: str | bytes) -> bytes:
    if isinstance(value, str) and "\0" in value:
        raise KeyError_("a bound can't hold NUL")
    return encode_key(value)


def interval_of(condition: Condition | None) -> Interval | None:
    """The interval of a condition; None if no key can meet it."""
    if condition is None:
        return EVERYTHING
    op, value, other = condition.op, condition.value, condition.other
    if op == "begins_with":
        if value in ("", b""):
            return EVERYTHING
        prefix = _bound(value)
        return Interval(prefix, True, successor(prefix), False)
    if op == "eq":
        return Interval(_bound(value), True, _bound(value), True)
    if op in ("gt", "gte"):
        return Interval(_bound(value), op == "gte")
    if op in ("lt", "lte"):
        return Interval(None, True, _bound(value), op == "lte")
    if op == "between":
        low, high = _bound(value), _bound(other)
        return Interval(low, True, high, True) if low <= high else None
    if op == "range":
        low = None if value is None else _bound(value)
        high = None if other is None else _bound(other)
        if low is not None and high is not None and (low > high or (low == high and not (condition.low_in and condition.high_in))):
            return None
        return Interval(low, condition.low_in, high, condition.high_in)
    raise ValueError(f"no such condition: {op}")


# Slices of a range partition own [start, end); None is open.


def intersects(start: bytes | None, end: bytes | None, i: Interval) -> bool:
    below = start is None or i.high is None or start < i.high or (i.high_in and start == i.high)
    above = end is None or i.low is None or i.low < end
    return below and above


def clip(start: bytes | None, end: bytes | None, i: Interval) -> Interval:
    """The part of an interval inside a slice."""
    low, low_in, high, high_in = i.low, i.low_in, i.high, i.high_in
    if start is not None and (low is None or start > low):
        low, low_in = start, True
    if end is not None and (high is None or end <= high):
        high, high_in = end, False
    return Interval(low, low_in, high, high_in)


def before_cursor(start: bytes | None, end: bytes | None, cursor: bytes, forward: bool) -> bool:
    """Whether a scan that stopped at ``cursor`` is done with the slice."""
    return (end is not None and end <= cursor) if forward else (start is not None and start >= cursor)


def falls_in(start: bytes | None, end: bytes | None, cursor: bytes) -> bool:
    return (start is None or start <= cursor) and (end is None or cursor < end)


def boundary_cursor(start: bytes | None, end: bytes | None, forward: bool) -> tuple[bytes | None, bool]:
    """Where the next slice's scan begins, and whether that key is included."""
    return (end, True) if forward else (start, False)


def intersects_column(start: Column, end: Column, low: Column, high: Column, high_in: Column) -> Column:
    """``intersects`` on columns; absent bounds are null or no bytes."""
    open_start, open_end = start.isNull() | (F.octet_length(start) == 0), end.isNull() | (F.octet_length(end) == 0)
    below = open_start | high.isNull() | (start < high) | (high_in & (start == high))
    return below & (open_end | low.isNull() | (low < end))
