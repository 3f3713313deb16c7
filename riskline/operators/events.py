"""Repeated procedures: filtering, history per person and refractory thinning.

A person may own any share of the procedure rows.  Rows are therefore first
reduced to one per person and day by a combining aggregate, and only then
gathered per person, so a gathered history never holds more than one entry per
calendar day of follow-up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.functions import calendar as cal


def procedure_filter(
    df: DataFrame, include: Sequence[int] | None = None, exclude: Sequence[int] | None = None
) -> DataFrame:
    """Keep or drop procedure types; a missing type is dropped either way."""
    kind = F.col("proc_type")
    if include is not None:
        df = df.where(kind.isin(list(include)))
    if exclude is not None:
        df = df.where(~kind.isin(list(exclude)))
    return df


def one_per_day(df: DataFrame, key: str = "bene_id", day: str = "proc_date", kind: str = "proc_type") -> DataFrame:
    """One row per person and day, with the lowest type code of that day."""
    return df.groupBy(key, day).agg(F.min(kind).alias(kind))


def with_gaps(daily: DataFrame, key: str = "bene_id", day: str = "proc_date") -> DataFrame:
    """Add the gap in years to the person's previous procedure, 0 for the first.

    Expects one row per person and day, so the ordered group is bounded by the
    days of a life.
    """
    previous = F.lag(day).over(Window.partitionBy(key).orderBy(day))
    daily = daily.withColumn("_previous", previous)
    gap = F.coalesce(cal.calendar_div(F.col("_previous"), F.col(day), 12), F.lit(0.0))
    return daily.withColumn("gap", gap).drop("_previous")


def gather_history(daily: DataFrame) -> DataFrame:
    """One row per person with the date-sorted array ``procs`` of (proc_date, proc_type, gap)."""
    return with_gaps(daily).groupBy("bene_id").agg(
        F.sort_array(F.collect_list(F.struct("proc_date", "proc_type", "gap"))).alias("procs")
    )


def attach_history(people: DataFrame, procedures: DataFrame) -> DataFrame:
    """People with the procedures up to their end of follow-up as ``procs``."""
    history = gather_history(one_per_day(procedures.join(people.select("bene_id"), "bene_id", "left_semi")))
    until_end = F.filter("procs", lambda p: p["proc_date"] <= F.col("end_date"))
    return people.join(history, "bene_id", "left").withColumn("procs", until_end)


def attach_enrollment(procedures: DataFrame, people: DataFrame) -> DataFrame:
    """Every procedure observed by the end of follow-up, with the person's dates."""
    dates = people.select("bene_id", "baseline", "end_date", "min_age_date")
    return procedures.join(dates, "bene_id").where(F.col("proc_date") <= F.col("end_date"))


def had_prior_procedure(procs: Column, before: Column) -> Column:
    """True if the first procedure precedes the given date (array form)."""
    return F.coalesce(F.get(procs, F.lit(0))["proc_date"] < before, F.lit(False))


def prior_procedure_ids(enrolled: DataFrame) -> DataFrame:
    """Ids whose first procedure precedes the minimum age (row form)."""
    return (
        enrolled.groupBy("bene_id")
        .agg(F.min("proc_date").alias("first_date"), F.first("min_age_date").alias("min_age_date"))
        .where(F.col("first_date") < F.col("min_age_date"))
        .select("bene_id")
    )


def thin_history(procs: Column, years: float) -> Column:
    """Drop procedures within ``years`` of the last kept one from a sorted history.

    Gaps between neighbours, in fractional calendar years, add up since the last
    kept entry; an entry is kept when the total exceeds ``years``.
    """
    start = F.struct(
        F.lit(0.0).alias("since"),
        F.slice(procs, 1, 1).alias("kept"),
    )

    def step(state, p):
        since = state["since"] + p["gap"]
        return F.when(
            since > years, F.struct(F.lit(0.0).alias("since"), F.concat(state["kept"], F.array(p)).alias("kept"))
        ).otherwise(F.struct(since.alias("since"), state["kept"].alias("kept")))

    return F.aggregate(procs, start, step, lambda s: s["kept"])


def thin_events(
    df: DataFrame, key: str = "bene_id", day: str = "proc_date", kind: str = "proc_type", years: float = 1.0
) -> DataFrame:
    """Refractory thinning of an event table: first event, then the next one > ``years`` later, and so on."""
    named = df.select(
        F.col(key).alias("bene_id"), F.col(day).cast("date").alias("proc_date"), F.col(kind).cast("int").alias("proc_type")
    )
    kept = gather_history(one_per_day(named)).select(
        "bene_id", F.explode(thin_history(F.col("procs"), years)).alias("p")
    )
    return kept.select(
        F.col("bene_id").alias(key), F.col("p.proc_date").alias(day), F.col("p.proc_type").alias(kind)
    )


def index_events(df: DataFrame, baseline: DataFrame, months: int = 3) -> DataFrame:
    """Interval index, time since baseline and gap to the previous kept procedure, in row form."""
    dates = baseline.select("bene_id", "baseline")
    previous = F.lag("proc_date").over(Window.partitionBy("bene_id").orderBy("proc_date"))
    return (
        df.join(dates, "bene_id")
        .withColumn("_previous", previous)
        .withColumns(
            {
                "proc_time": cal.calendar_div(F.col("baseline"), F.col("proc_date"), months),
                "int": cal.interval_index(F.col("baseline"), F.col("proc_date"), months),
                "t_between": cal.calendar_div(F.col("_previous"), F.col("proc_date"), 12),
            }
        )
        .drop("baseline", "_previous")
    )
