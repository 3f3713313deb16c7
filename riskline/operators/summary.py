"""Descriptive tables and bootstrap summaries.

Ratios are taken over already aggregated cells, so the windows below only see
one row per category combination.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.functions import calendar as cal
from riskline.operators.quantiles import group_summary


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per row and column, as (variable, level), missing levels left out."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(*keep, "_p.*").where("level IS NOT NULL")


def crosstab_oneway(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency and proportion of each level of each column, from one grouping."""
    counts = _long(df, columns).groupBy("variable", "level").agg(_count())
    return counts.withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy("variable")))


def crosstab_colprop(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Counts of each column's levels by ``y`` with proportions within ``y``; empty cells included."""
    grid = _full_grid(_long(df, columns, [y]), ["variable"], "level", y)
    return grid.withColumn("prop_col", F.col("n") / F.sum("n").over(Window.partitionBy("variable", y)))


def _full_grid(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Counts for every combination of the levels seen in ``x`` and ``y``, zero where empty."""
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(_count())
    margin = Window.partitionBy(*by)
    seen = counts.withColumn("_ys", F.collect_set(y).over(margin))
    rows = seen.groupBy(*by, x).agg(
        F.first("_ys").alias("_ys"), F.map_from_entries(F.collect_list(F.struct(y, "n"))).alias("_n")
    )
    full = rows.select(*by, x, F.explode("_ys").alias(y), "_n")
    return full.withColumn("n", F.coalesce(F.try_element_at("_n", F.col(y)), F.lit(0))).drop("_n")


def crosstab_chisq(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-way counts with row, column and total proportions and each cell's chi-square share."""
    grid = _full_grid(df, by, x, y)
    row, column, total = (
        F.sum("n").over(Window.partitionBy(*by, *k)) for k in ([x], [y], [])
    )
    expected = row * column / total
    return grid.withColumns(
        {
            "prop_row": F.col("n") / row,
            "prop_col": F.col("n") / column,
            "prop_total": F.col("n") / total,
            "chisq": (F.col("n") - expected) * (F.col("n") - expected) / expected,
        }
    )


def summary_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, mean and maximum of a column, overall or per group (NULL is a group)."""
    names = {s: s for s in ("min", "mean", "max", "n")}
    return group_summary(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, names=names)


def followup_length(df: DataFrame) -> DataFrame:
    """Total and median follow-up in months, one person per row."""
    lengths = df.select(cal.calendar_div(F.col("baseline"), F.col("end_date"), 1).alias("length"))
    return group_summary(lengths, [], "length", {"med_length": 0.5}, names={"sum": "tot_length"})


def overall_weight_stats(summary: DataFrame) -> DataFrame:
    """Mean, min and max over all times of the average, minimum and maximum weight."""
    picks = {"mean": F.avg, "min": F.min, "max": F.max}
    return summary.agg(
        *[fn(c).alias(f"{name}_{c}") for c in ("avg_wt", "min_wt", "max_wt") for name, fn in picks.items()]
    )


def curve_measures(causes: Sequence[str] = ("primary", "competing"), ratios: bool = True) -> list[str]:
    """Names of the risks and contrasts held by an aligned curve."""
    names = []
    for c in causes:
        names += [f"risk_{c}0", f"risk_{c}1", f"rd_{c}"] + ([f"rr_{c}"] if ratios else [])
    return names


def on_reference_grid(curves: DataFrame, measures: Sequence[str], reps: int) -> DataFrame:
    """Every replicate's curve carried forward onto the times of replicate 0.

    One pass over the curves: the grid times are added to each replicate as empty
    rows and filled from the last row at or before them.
    """
    base = curves.where("rep = 0").select("time").distinct()
    slots = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps)))).withColumn("_grid", F.lit(1))
    both = (
        curves.select("rep", "time", *measures, F.lit(0).alias("_grid"))
        .unionByName(slots, allowMissingColumns=True)
        .groupBy("rep", "time")
        .agg(*[F.max(m).alias(m) for m in measures], F.max("_grid").alias("_grid"),
             F.min("_grid").alias("_only"))
    )
    w = Window.partitionBy("rep").orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("_only") == 0, F.struct(*measures)), ignorenulls=True).over(w)
    return both.withColumn("_at", latest).where("_grid = 1").select("rep", "time", "_at.*")


def boot_percentiles(curves: DataFrame, measures: Sequence[str], probs=(0.025, 0.975)) -> DataFrame:
    """Lower and upper percentiles of each measure per time over the replicates.

    A group holds one value per replicate, so the built-in percentile is enough.
    """
    clean = curves.select("time", *[F.when(~F.isnan(m), F.col(m)).alias(m) for m in measures])
    both = clean.groupBy("time").agg(*[F.percentile(m, F.array(*map(F.lit, probs))).alias(m) for m in measures])
    return both.select(
        "time", *[F.get(m, F.lit(i)).alias(f"{m}_{tag}") for m in measures for i, tag in enumerate(("ll", "ul"))]
    )


def boot_se(curves: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Standard deviation of each measure per time over the replicates, undefined values left out."""
    return curves.groupBy("time").agg(*[F.stddev_samp(F.when(~F.isnan(m), F.col(m))).alias(f"se_{m}") for m in measures])


def summarise_bootstrap(
    curves: DataFrame, measures: Sequence[str], reps: int, mode: str = "asof", kind: str = "percentile"
) -> DataFrame:
    """Replicate 0 with intervals from all replicates.

    ``asof`` carries each replicate onto the times of replicate 0 first; ``exact``
    uses only the replicates that have a row at exactly that time.
    """
    placed = on_reference_grid(curves, measures, reps) if mode == "asof" else curves
    spread = boot_percentiles(placed, measures) if kind == "percentile" else boot_se(placed, measures)
    return curves.where("rep = 0").drop("rep").join(spread, "time", "left")
