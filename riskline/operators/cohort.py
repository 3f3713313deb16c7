"""Eligible cohort, first event and event times: one row per person throughout."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.functions import calendar as cal
from riskline.functions.expressions import earlier_of, if_else, later_of
from riskline.sources.schema import CONDITIONS


def with_baseline(subjects: DataFrame, cutoff: date, wash_in: int = 6, min_age: int = 50) -> DataFrame:
    """Baseline date, administrative end of follow-up and exposure at baseline.

    Baseline is the later of ``wash_in`` months after enrolment and the minimum
    age; it is NULL when the wash-in day does not exist in the calendar.
    """
    baseline0 = cal.add_months_strict(F.col("start_date"), wash_in)
    return (
        subjects.withColumn("dob", cal.recode_leap_day(F.col("dob")))
        .withColumn("min_age_date", F.add_months("dob", min_age * 12))
        .withColumn("baseline", later_of(F.col("min_age_date"), baseline0))
        .withColumn("end_date", earlier_of(F.col("end_date"), F.lit(cutoff)))
        .withColumn(
            "exposed",
            F.when(F.col("exposure_date").isNull(), 0).otherwise(
                (F.col("exposure_date") <= F.col("baseline")).cast("int")
            ),
        )
    )


def eligible(df: DataFrame) -> DataFrame:
    """People alive, free of any prior diagnosis and still enrolled after baseline."""
    first_stop = F.least("dod", "any_date_type1", "end_date")
    return df.where(F.col("end_date").isNotNull() & (first_stop > F.col("baseline")))


def with_first_event(df: DataFrame) -> DataFrame:
    """Date and kind of the first event; ties go to primary, then death, then censoring."""
    day = F.col("event_date")
    return df.withColumn(
        "event_date", F.least("end_date", "primary_date", "any_date_type2", "dod")
    ).withColumn(
        "first_event",
        F.when(day == F.col("primary_date"), "primary")
        .when(day == F.col("dod"), "competing")
        .when((day == F.col("any_date_type2")) | (day == F.col("end_date")), "censor"),
    )


def restrict_window(df: DataFrame, start: date) -> DataFrame:
    """Follow-up after ``start`` only, with baseline moved up to it.

    Eligibility and exposure stay as judged at the original baseline.
    """
    return df.where(F.col("event_date") > F.lit(start)).withColumn(
        "baseline", later_of(F.col("baseline"), F.lit(start))
    )


def exclude_if_within(df: DataFrame, lower: int = 0, upper: int = 60) -> DataFrame:
    """Recode a primary event as censoring when the exclusion diagnosis follows within days."""
    gap = F.datediff("exclusion_date", "primary_date")
    hit = (F.col("first_event") == "primary") & F.coalesce(gap.between(lower, upper), F.lit(False))
    return df.withColumn("first_event", F.when(hit, "censor").otherwise(F.col("first_event")))


def with_event_times(df: DataFrame, months: int = 3) -> DataFrame:
    """Age and year at baseline, event time in periods and its interval index."""
    b, e = F.col("baseline"), F.col("event_date")
    return df.withColumns(
        {
            "age_base": cal.whole_periods(F.col("dob"), b, 12),
            "yr_base": F.year(b),
            "event_time": cal.calendar_div(b, e, months),
            "event_int": cal.interval_index(b, e, months),
        }
    ).where(F.col("event_date") >= F.col("baseline"))


def with_condition_onsets(df: DataFrame, months: int = 3) -> DataFrame:
    """Onset interval of each condition (``onset_01`` …), NULL if never diagnosed."""
    return df.withColumns(
        {f"onset_{c}": cal.onset_index(F.col("baseline"), F.col(f"cond_{c}_date"), months) for c in CONDITIONS}
    )


def build_cohort(
    subjects: DataFrame,
    cutoff: date,
    wash_in: int = 6,
    min_age: int = 50,
    window_from: date | None = None,
    months: int = 3,
) -> DataFrame:
    """Eligible people with first event and event times."""
    df = with_first_event(eligible(with_baseline(subjects, cutoff, wash_in, min_age)))
    if window_from is not None:
        df = restrict_window(df, window_from)
    return with_event_times(exclude_if_within(df), months)


def four_state_event(cohort: DataFrame) -> DataFrame:
    """Event code 0 censored, 1 primary, 2 other diagnosis, 3 death for the yearly panel."""
    other = (F.col("first_event") == "censor") & (F.col("event_date") == F.col("any_date_type2"))
    return cohort.withColumn(
        "event4",
        F.when(F.col("first_event") == "primary", 1)
        .when(F.col("first_event") == "competing", 3)
        .when(if_else(other, F.lit(True), F.lit(False)), 2)
        .otherwise(0),
    )


def distinct_ids(df: DataFrame, key: str = "bene_id") -> DataFrame:
    return df.select(key).distinct()


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "bene_id") -> DataFrame:
    """Rows whose key is among ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, key: str = "bene_id") -> DataFrame:
    """Rows whose key is not among ``ids``."""
    return df.join(ids.select(key), key, "left_anti")
