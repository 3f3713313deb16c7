"""Ordered operations within a person.

The window functions here are meant for person-interval rows: a person has at
most one row per calendar interval, so one window group is bounded by the
length of follow-up.  First/last row per key is an aggregate instead of a
ranking window, so it combines map-side and no key is too large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_person(*order: str, key: str | Sequence[str] = "bene_id") -> WindowSpec:
    """Window over one person's rows in order."""
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(*order)


def running(window: WindowSpec) -> WindowSpec:
    """Frame from the first row to the current one."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_current(window: WindowSpec) -> WindowSpec:
    """Frame from the first row to the one before the current."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def lag_or_current(value: Column, window: WindowSpec, n: int = 1, fallback: Column | None = None) -> Column:
    """Value ``n`` rows back, else ``fallback`` (the current value by default)."""
    return F.coalesce(F.lag(value, n).over(window), value if fallback is None else fallback)


def running_sum(value: Column, window: WindowSpec) -> Column:
    return F.sum(value).over(running(window))


def still_all(flag: Column, window: WindowSpec) -> Column:
    """1 while every flag so far is 1; the running product of a 0/1 column."""
    return F.min(flag).over(running(window))


def carry_forward(value: Column, window: WindowSpec) -> Column:
    """Last non-missing value up to and including the current row."""
    return F.last(value, ignorenulls=True).over(running(window))


def carry_forward_excluding(value: Column, own: Column, window: WindowSpec) -> Column:
    """Last non-missing value, taken from the rows before where ``own`` holds."""
    prior = F.last(value, ignorenulls=True).over(before_current(window))
    return F.when(own, prior).otherwise(carry_forward(value, window))


def through_first(flag: Column, window: WindowSpec) -> Column:
    """True on the rows up to and including the first row whose 0/1 flag is set."""
    return F.coalesce(F.sum(flag).over(before_current(window)), F.lit(0)) == 0


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], chooser) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(chooser(row, rank).alias("_row")).select("_row.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``; ``order`` must identify it."""
    return _pick(df, keys, order, F.max_by)
