"""Calendar arithmetic on date columns.

All functions take and return ``Column`` objects built from JVM functions, so
they stay inside generated code.  Periods are given in months: 12 for years,
3 for quarters, 1 for months.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean length of a month in days, used for duration arithmetic.
DAYS_PER_MONTH = 30.4375


def add_months_strict(day: Column, months: Column | int) -> Column:
    """Same day of the month ``months`` later, NULL where that day does not exist."""
    moved = F.add_months(day, months)
    return F.when(F.dayofmonth(moved) == F.dayofmonth(day), moved)


def add_month_durations(day: Column, months: Column | int) -> Column:
    """``day`` plus a fixed-length month duration, truncated to whole days."""
    days = F.floor((months if isinstance(months, Column) else F.lit(months)) * F.lit(DAYS_PER_MONTH))
    return F.date_add(day, days.cast("int"))


def whole_periods(start: Column, end: Column, months: int) -> Column:
    """Number of whole calendar periods from ``start`` to ``end`` (negative if before).

    A period is complete on the same day of the month, or on the last day of a
    month that is too short to have it.
    """
    elapsed = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    short = (F.dayofmonth(start) > F.dayofmonth(end)) & (end != F.last_day(end))
    return F.floor((elapsed - short.cast("int")) / F.lit(months)).cast("int")


def calendar_div(start: Column, end: Column, months: int) -> Column:
    """Elapsed calendar periods as a double: whole periods plus the day fraction."""
    whole = whole_periods(start, end, months)
    lower = F.add_months(start, whole * months)
    upper = F.add_months(start, (whole + 1) * months)
    return whole + F.datediff(end, lower) / F.datediff(upper, lower)


def interval_index(start: Column, day: Column, months: int = 3) -> Column:
    """1-based interval holding ``day``; a day on a boundary opens the next interval."""
    return whole_periods(start, day, months) + 1


def onset_index(start: Column, day: Column, months: int = 3) -> Column:
    """Interval count rounded up, without moving boundary days to the next interval."""
    whole = whole_periods(start, day, months)
    return whole + (day > F.add_months(start, whole * months)).cast("int")


def interval_start(start: Column, index: Column, months: int = 3) -> Column:
    """First day of interval ``index``; duration arithmetic where the day does not exist."""
    offset = (index - 1) * months
    return F.coalesce(add_months_strict(start, offset.cast("int")), add_month_durations(start, offset))


def recode_leap_day(day: Column) -> Column:
    """Move 29 February to 28 February."""
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return F.when(leap, F.date_sub(day, 1)).otherwise(day)


def us_date(text: Column) -> Column:
    """Parse month-day-year text."""
    return F.to_date(text, "MM-dd-yyyy")


def iso_date_prefix(text: Column) -> Column:
    """Date held in the first ten characters of a timestamp text."""
    return F.to_date(F.substring(text, 1, 10))
