"""Exact quantiles of groups of any size, whatever value is frequent, from one range partitioning.

The built-in exact percentile holds all distinct values of a group in one task.
Here rows first become a histogram, a row for each group and distinct value, by a
combining aggregate, so a value that stands in most rows weighs no more than any other.
The histogram is range-partitioned by group and value.  Each range's share of each group
tells which ranges hold the wanted ranks, and only those are ordered: a running sum
inside the range after what lies in the ones before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.operators.lineage import written


def histogram(df: DataFrame, by: Sequence[str], value: str, freq: Column | None = None) -> DataFrame:
    """(by, value, n) of the distinct values of each group, written in ranges ``_part`` of about equally many.

    ``freq`` repeats a row a whole number of times.  NULL and NaN are left out;
    NULL is a group like any other.
    """
    by = list(by)
    v = F.col(value).cast("double").alias(value)
    rows = df.select(*by, v, (F.lit(1) if freq is None else freq).cast("bigint").alias("n"))
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col("n") > 0))
    counts = rows.groupBy(*by, value).agg(F.sum("n").alias("n"))
    return written(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranges")


def _ranks(p: float) -> list[Column]:
    """The ranks whose values a quantile lies between, of ``(n - 1) p``."""
    rank = (F.col("_total") - 1) * F.lit(float(p))
    return [F.floor(rank), F.ceil(rank)]


def _quantile(value: str, p: float) -> Column:
    """The linearly interpolated quantile of a group, as an aggregate over rows that hold the ranks ``_from`` to before ``_upto``."""
    low, high = (F.max(F.when((r >= F.col("_from")) & (r < F.col("_upto")), F.col(value))) for r in _ranks(p))
    rank = (F.col("_total") - 1) * F.lit(float(p))
    share = F.max(rank - F.floor(rank))
    return F.when((share == 0) | (low == high), low).otherwise(low * (1 - share) + high * share)


def group_summary(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], freq: Column | None = None, names: Mapping[str, str] | None = None
) -> DataFrame:
    """Quantiles of ``value`` per group, a column for each of ``probs`` (name to probability).

    ``names`` adds columns for any of ``n``, ``sum``, ``mean``, ``min`` and ``max`` (statistic to column name).
    """
    by = list(by)
    held = histogram(df, by, value, freq)
    shares = held.groupBy(*by, "_part").agg(
        F.sum("n").alias("_n"), F.sum(F.col(value) * F.col("n")).alias("_sum"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )
    group = Window.partitionBy(*by)
    ahead = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shares = shares.withColumns(
        {
            "_ahead": F.coalesce(ahead, F.lit(0)), "_total": F.sum("_n").over(group), "_sum": F.sum("_sum").over(group),
            "_min": F.min("_min").over(group), "_max": F.max("_max").over(group),
        }
    )
    # Where no quantile is asked for, one range a group is enough.
    ranks = [r for p in probs.values() for r in _ranks(p)] or [F.lit(0)]
    wanted = reduce(or_, [(r >= F.col("_ahead")) & (r < F.col("_ahead") + F.col("_n")) for r in ranks])
    keys, stats = [*by, "_part"], ["_ahead", "_total", "_sum", "_min", "_max"]
    hot = written(shares.where(wanted).select(*[F.col(c).alias(f"_key_{c}") for c in keys], *stats), "shares")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    rows = held.join(hot, same).select(*by, value, "n", "_part", *stats)
    if by:  # once, for the running sums and the result
        rows = rows.repartition(*by)
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_upto", F.col("_ahead") + F.sum("n").over(inside)).withColumn("_from", F.col("_upto") - F.col("n"))
    made = {"n": F.max("_total"), "sum": F.max("_sum"), "mean": F.max("_sum") / F.max("_total"), "min": F.max("_min"), "max": F.max("_max")}
    out = [made[s].alias(c) for s, c in (names or {}).items()] + [_quantile(value, p).alias(c) for c, p in probs.items()]
    return rows.groupBy(*by).agg(*out)


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    freq: Column | None = None,
) -> DataFrame:
    """Quantiles of ``value`` per group: ``by`` plus one column per probability."""
    return group_summary(df, by, value, dict(zip(names, probs, strict=True)), freq)
