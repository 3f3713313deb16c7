"""Adherence to a repeat-procedure protocol, covariate history and outcome codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.functions import sequence as seq
from riskline.functions.expressions import ENROLL_PERIODS, cap_count, period_bin


def drop_missing(df: DataFrame, columns: Sequence[str] = ("race", "sex")) -> DataFrame:
    return df.dropna(subset=list(columns))


def adherent(every_years: float, tolerance: float = 0.25) -> Column:
    """0 when overdue, or when a repeat procedure came too early; else 1."""
    since = F.col("years_since_proc")
    repeat = (F.col("proc") == 1) & (F.col("prior_proc") == 1)
    return (
        F.when(since > every_years + tolerance, 0)
        .when(repeat & (since < every_years - tolerance), 0)
        .otherwise(1)
    )


def adherent_age_band(age: Column, count: Column) -> Column:
    """Age-band protocol on the cumulative procedure count.

    None before 50, at most one before 60, at least one at 60, at most two after.
    """
    return (
        F.when((age < 50) & (count > 0), 0)
        .when((age >= 50) & (age < 60) & (count > 1), 0)
        .when((age == 60) & (count == 0), 0)
        .when((age > 60) & (count > 2), 0)
        .otherwise(1)
    )


def outcome_code() -> Column:
    """0 before the event interval or if censored, 1 primary, 2 competing."""
    return (
        F.when(F.col("int") != F.col("event_int"), 0)
        .when(F.col("first_event") == "censor", 0)
        .when(F.col("first_event") == "primary", 1)
        .otherwise(2)
    )


def with_lagged_conditions(df: DataFrame, order: str = "int") -> DataFrame:
    """Condition count in bins 0, 1, 2+ with its values one and two rows back."""
    w = seq.by_person(order)
    df = df.withColumn("n_cond", cap_count(F.col("n_cond")))
    one_back = seq.lag_or_current(F.col("n_cond"), w)
    return df.withColumns(
        {"n_cond_1": one_back, "n_cond_2": F.coalesce(F.lag("n_cond", 2).over(w), one_back)}
    )


def with_screen_history(df: DataFrame, order: str = "int") -> DataFrame:
    """Lags of the adherence flag (1 before the first row) and the still-adherent flag."""
    w = seq.by_person(order)
    return df.withColumns(
        {
            "screen_1": F.lag("screen", 1, 1).over(w),
            "screen_2": F.lag("screen", 2, 1).over(w),
            "cum_screen": seq.still_all(F.col("screen"), w),
        }
    )


def apply_protocol(
    panel: DataFrame,
    every_years: float = 10,
    tolerance: float = 0.25,
    periods: Sequence[tuple[int, int]] = ENROLL_PERIODS,
) -> DataFrame:
    """Panel with model covariates, adherence flags and outcome; one sort by person."""
    df = drop_missing(panel).withColumns(
        {
            "enroll_period": period_bin(F.col("yr_base"), periods),
            "screen": adherent(every_years, tolerance),
            "event": outcome_code(),
        }
    )
    return with_screen_history(with_lagged_conditions(df))


def apply_age_band_protocol(yearly: DataFrame, periods: Sequence[tuple[int, int]] = ENROLL_PERIODS) -> DataFrame:
    """Yearly panel with covariates and the age-band adherence flags."""
    df = drop_missing(yearly, ("age", "race", "sex")).withColumns(
        {
            "enroll_period": period_bin(F.col("yr_base"), periods),
            "cum_proc": seq.running_sum(F.col("proc"), seq.by_person("age")),
        }
    )
    df = df.withColumn("screen", adherent_age_band(F.col("age"), F.col("cum_proc")))
    return with_screen_history(with_lagged_conditions(df, "age"), "age")


def through_first_deviation(panel: DataFrame) -> DataFrame:
    """Rows up to and including the first deviation of each person."""
    df = panel.withColumns(
        {
            "age_int": F.floor("age_start").cast("int"),
            "deviate": (F.col("screen") == 0).cast("int"),
        }
    )
    keep = seq.through_first(F.col("deviate"), seq.by_person("int"))
    return df.withColumn("_keep", keep).where("_keep").drop("_keep")


def first_deviation(panel: DataFrame) -> DataFrame:
    """Counts of follow-up rows by exposure, integer age and deviation."""
    return through_first_deviation(panel).groupBy("exposed", "age_int", "deviate").agg(
        F.count(F.lit(1)).alias("n")
    )
