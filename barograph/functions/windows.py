"""Causal windows over the bars of a symbol, with the conventions of rolling statistics: a minimum of known values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    """The rows of a symbol in order of date. A function, since a window can only be made once a session runs."""
    return Window.partitionBy("symbol").orderBy("date")


def roll(fn: Callable[[Column], Column], x: Column | str, n: int, least: int, w: WindowSpec | None = None) -> Column:
    """``fn`` over the last n rows; null where fewer than ``least`` of them are known."""
    x = F.col(x) if isinstance(x, str) else x
    frame = (w or by_symbol()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= least, fn(x).over(frame))


def centered(fn: Callable[[Column], Column], x: str, n: int, least: int, w: WindowSpec | None = None) -> Column:
    """``fn`` over n rows around each; an even n has one row more before."""
    frame = (w or by_symbol()).rowsBetween(-(n // 2), n // 2 - (n % 2 == 0))
    return F.when(F.count(F.col(x)).over(frame) >= least, fn(F.col(x)).over(frame))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def change(x: Column | str, k: int = 1, w: WindowSpec | None = None) -> Column:
    """x / x k rows before - 1."""
    x = F.col(x) if isinstance(x, str) else x
    return ratio(x, F.lag(x, k).over(w or by_symbol())) - 1


def fill_forward(x: str, w: WindowSpec | None = None) -> Column:
    return F.last(x, ignorenulls=True).over((w or by_symbol()).rowsBetween(Window.unboundedPreceding, 0))


def fill_both(x: str, w: WindowSpec | None = None) -> Column:
    """Forward, then backward."""
    return F.coalesce(fill_forward(x, w), F.first(x, ignorenulls=True).over((w or by_symbol()).rowsBetween(0, Window.unboundedFollowing)))
