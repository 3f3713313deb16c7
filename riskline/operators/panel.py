"""Person-interval panel.

The cohort row of a person carries the whole (thinned) procedure history, so
the panel is one ``explode`` of that row: interval bounds, condition flags,
procedure matches and carried-forward history are plain expressions on it.
Intervals and procedures are merged by the stretches between procedures, in time
proportional to their number; an interval has a row for each of its procedures, or
one without.  No window, join or second shuffle is needed, and the rows stay
where the person is.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.functions import calendar as cal
from riskline.operators import events as ev
from riskline.sources.schema import CONDITIONS, PANEL_COLUMNS


def with_interval_count(
    people: DataFrame, cutoff: date, months: int = 3, age_cap: int = 65, preserve_boundary_event: bool = False
) -> DataFrame:
    """Number of follow-up intervals (``n_int``) and whether a drop-out row follows.

    An event on the first day of its interval leaves that interval empty: it is
    dropped and the event is not coded.  With ``preserve_boundary_event`` the
    event is coded in the interval before instead.
    """
    last_start = cal.interval_start(F.col("baseline"), F.col("event_int"), months)
    people = people.withColumn("_empty", (last_start >= F.col("event_date")).cast("int"))
    people = people.withColumn("n_int", F.col("event_int") - F.col("_empty"))
    if preserve_boundary_event:
        people = people.withColumn("event_int", F.col("n_int"))
    cap = cal.add_months_strict(F.add_months("dob", age_cap * 12), -1)
    dropped = (
        (F.col("n_int") == F.col("event_int"))
        & (F.col("first_event") == "censor")
        & (F.col("event_date") < cap)
        & (F.col("event_date") < F.lit(cutoff))
    )
    # No interval is left only if the event falls on the baseline day itself.
    return (
        people.where(F.col("event_date") > F.col("baseline"))
        .withColumn("n_drop", F.coalesce(dropped, F.lit(False)).cast("int"))
        .drop("_empty")
    )


def _bounds(i: Column, months: int) -> list[Column]:
    """Number, start and stop date of an interval or the drop-out row; ``stop`` is the next start, or the event date in the event interval."""
    event, base = F.col("event_date"), F.col("baseline")
    is_drop = i > F.col("n_int")
    return [
        i.alias("int"),
        F.when(is_drop, event).otherwise(cal.interval_start(base, i, months)).alias("int_start"),
        F.when(is_drop, F.date_add(event, 1))
        .when(i == F.col("event_int"), event)
        .otherwise(cal.interval_start(base, i + 1, months))
        .alias("stop"),
    ]


def expand_intervals(people: DataFrame, months: int = 3) -> DataFrame:
    """One row per interval ``int`` = 1, 2, … and the one-day drop-out row, with start and stop date.

    The dates are built once per interval inside the exploded array, so later steps
    refer to plain columns.
    """
    rows = F.transform(F.sequence(F.lit(1), F.col("n_int") + F.col("n_drop")), lambda i: F.struct(*_bounds(i, months)))
    return people.withColumn("_i", F.explode(rows)).select("*", "_i.*").drop("_i")


def expand_history(people: DataFrame, months: int = 3) -> DataFrame:
    """The rows of ``expand_intervals``, one for each procedure of the interval, with the date of the last one before.

    ``procs`` is a person's sorted history.  Stretch j has the row of procedure j and
    the rows of the intervals up to the next procedure; stretch 0 those before the first.
    Intervals are bounded by calendar anchors counted from baseline.  Procedures
    outside them belong to no interval, so they neither set the flag nor the last date.
    """
    n = F.col("n_int") + F.col("n_drop")

    def place(p: Column) -> Column:
        day = p["proc_date"]
        index = cal.interval_index(F.col("baseline"), day, months).cast("int")
        return F.struct(index.alias("int"), day.alias("proc_date"), p["proc_type"].alias("proc_type"))

    none = F.filter(F.array(place(F.struct(F.lit(None).cast("date").alias("proc_date"), F.lit(None).cast("int").alias("proc_type")))), lambda p: F.lit(False))
    inside = F.filter(F.transform("procs", place), lambda p: (p["int"] >= 1) & (p["int"] <= n))
    people = people.withColumn("_own", F.coalesce(inside, none))
    own = F.col("_own")

    def stretch(j: Column) -> Column:
        this, last = F.get(own, j - 1), F.get(own, j - 2)["proc_date"]
        first = F.when(j == 0, F.lit(1)).otherwise(this["int"] + 1)
        until = F.when(j == F.size(own), n).otherwise(F.get(own, j)["int"] - 1)

        def row(i: Column, day: Column, kind: Column, before: Column) -> Column:
            return F.struct(*_bounds(i, months), day.alias("proc_date"), kind.alias("proc_type"), before.alias("date_last_proc"))

        blank = F.transform(
            F.sequence(first, until), lambda i: row(i, F.lit(None).cast("date"), F.lit(None).cast("int"), this["proc_date"])
        )
        empty = F.slice(F.array(row(F.lit(1), this["proc_date"], this["proc_type"], last)), 1, 0)
        with_own = F.when(j > 0, F.array(row(this["int"], this["proc_date"], this["proc_type"], last))).otherwise(empty)
        return F.concat(with_own, F.when(first <= until, blank).otherwise(empty))

    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.size(own)), stretch))
    return people.withColumn("_i", F.explode(rows)).select("*", "_i.*").drop("_i", "_own")


def with_interval_bounds(df: DataFrame) -> DataFrame:
    """Last day and ages at start and stop of each interval; drops ``stop``."""
    is_drop = F.col("int") > F.col("n_int")
    closes = is_drop | (F.col("int") == F.col("event_int"))
    return df.withColumns(
        {
            "drop": is_drop.cast("int"),
            "int_end": F.when(closes, F.col("stop")).otherwise(F.date_sub("stop", 1)),
            "age_start": cal.calendar_div(F.col("dob"), F.col("int_start"), 12),
            "age_end": cal.calendar_div(F.col("dob"), F.col("stop"), 12),
        }
    ).drop("stop")


def flag_onset(index: Column, onset: Column) -> Column:
    """1 from the onset interval on, 0 before or if there is no onset."""
    return F.coalesce((index >= onset).cast("int"), F.lit(0))


def with_condition_count(df: DataFrame, months: int = 3) -> DataFrame:
    """Number of conditions present in the interval (the drop-out row repeats the last one)."""
    df = df.withColumn("_by", F.add_months("baseline", F.least("int", "n_int") * months))
    flags = [F.coalesce((F.col(f"cond_{c}_date") <= F.col("_by")).cast("int"), F.lit(0)) for c in CONDITIONS]
    return df.withColumn("n_cond", sum(flags, F.lit(0))).drop("_by")


def with_procedures(df: DataFrame, months: int = 3) -> DataFrame:
    """What follows from the row's procedure and the last one before it."""
    since = F.coalesce("date_last_proc", "baseline")
    until = F.coalesce("proc_date", "int_end")
    return df.withColumns(
        {
            "proc": F.col("proc_date").isNotNull().cast("int"),
            "proc_time": cal.calendar_div(F.col("baseline"), F.col("proc_date"), months),
            "years_since_proc": cal.calendar_div(since, until, 12),
            "prior_proc": F.col("date_last_proc").isNotNull().cast("int"),
        }
    )


def people_with_history(cohort: DataFrame, procedures: DataFrame, years: float = 1.0) -> DataFrame:
    """Cohort without prior-procedure people, each with the thinned history ``procs``."""
    people = ev.attach_history(cohort, procedures)
    people = people.where(~ev.had_prior_procedure(F.col("procs"), F.col("min_age_date")))
    return people.withColumn("procs", ev.thin_history(F.col("procs"), years))


def panel_rows(
    cohort: DataFrame,
    procedures: DataFrame,
    cutoff: date,
    years: float = 1.0,
    months: int = 3,
    age_cap: int = 65,
    preserve_boundary_event: bool = False,
) -> DataFrame:
    """Rows of the panel with everything known about them, clustered by person."""
    people = people_with_history(cohort, procedures, years)
    people = with_interval_count(people, cutoff, months, age_cap, preserve_boundary_event)
    rows = with_interval_bounds(expand_history(people, months))
    return with_procedures(with_condition_count(rows, months), months)


def build_panel(cohort: DataFrame, procedures: DataFrame, cutoff: date, *args, **kwargs) -> DataFrame:
    """The person-interval panel, clustered by person; parameters as in ``panel_rows``."""
    return panel_rows(cohort, procedures, cutoff, *args, **kwargs).select(*PANEL_COLUMNS)


def yearly_panel(panel: DataFrame, event4: DataFrame) -> DataFrame:
    """Person-year rows ``(age - 1, age]`` with the four-state event in the last one.

    ``event4`` holds ``bene_id`` and the code of the person's first event.  The
    grouping keeps the panel's clustering by person.
    """
    rows = panel.where(F.col("drop") == 0).withColumn("age", F.floor("age_start").cast("int") + 1)
    years = rows.groupBy("bene_id", "age").agg(
        F.first("race").alias("race"),
        F.first("sex").alias("sex"),
        F.first("first_elig_state").alias("first_elig_state"),
        F.first("exposed").alias("exposed"),
        F.first("yr_base").alias("yr_base"),
        F.max("n_cond").alias("n_cond"),
        F.max("proc").alias("proc"),
        F.max((F.col("int") == F.col("event_int")).cast("int")).alias("_last"),
    )
    return years.join(event4.select("bene_id", "event4"), "bene_id").select(
        "bene_id", "age", "race", "sex", "first_elig_state", "n_cond", "yr_base", "proc",
        (F.col("_last") * F.col("event4")).alias("event"), "exposed",
    )
