"""Conditional, recoding, text and hashing expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enrolment periods as inclusive year ranges; later years fall in the last bin.
ENROLL_PERIODS = ((2001, 2005), (2006, 2010))


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that is NULL where the test is NULL."""
    return F.when(test.isNull(), F.lit(None)).when(test, yes).otherwise(no)


def later_of(a: Column, b: Column) -> Column:
    """Later of two dates, NULL if either is NULL (``greatest`` alone would skip it)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def earlier_of(a: Column, b: Column) -> Column:
    """Earlier of two dates, NULL if either is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def cap_count(count: Column, top: int = 2) -> Column:
    """Counts recoded to 0..top."""
    return F.when(count.isNotNull(), F.least(count, F.lit(top)))


def period_bin(year: Column, periods: Sequence[tuple[int, int]] = ENROLL_PERIODS) -> Column:
    """1-based index of the year range holding ``year``; all others get the last index."""
    expr = None
    for i, (lo, hi) in enumerate(periods, start=1):
        hit = year.between(lo, hi)
        expr = F.when(hit, i) if expr is None else expr.when(hit, i)
    return expr.otherwise(len(periods) + 1)


def clip_lower(value: Column, floor: float = 0.0) -> Column:
    """Values below ``floor`` raised to it; NULL stays NULL."""
    return F.when(value < floor, F.lit(floor)).otherwise(value)


def fixed_decimals(value: Column, places: int) -> Column:
    """Text with a fixed number of decimals, rounded half up."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.round(value, places)))


def interval_text(lower: Column, upper: Column, places: int) -> Column:
    """``(lower, upper)`` as text with fixed decimals."""
    return F.concat(
        F.lit("("), fixed_decimals(lower, places), F.lit(", "), fixed_decimals(upper, places), F.lit(")")
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient: NULL for 0/0, infinite for x/0."""
    return F.when(
        (denominator == 0) & (numerator != 0), F.lit(float("inf")) * F.signum(numerator)
    ).otherwise(F.try_divide(numerator, denominator))


def hash_uniform(seed: int | str, *parts: Column) -> Column:
    """Repeatable uniform number in [0, 1) from a seed and key columns.

    The draw depends on the key values only, never on row order or partitioning,
    so a lost task redraws the same numbers.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)
