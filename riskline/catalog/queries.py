"""Every registered query with the SQL that must give the same rows.

A query takes (spark, sf_dir), reads whole tables and returns a DataFrame whose
columns are listed in a short spec: ``name:kind`` with i integer, x double
rounded to six places, w to three (for fitted values), d date as text, s text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.catalog import base_sql as q
from riskline.functions import calendar as cal
from riskline.functions import expressions as ex
from riskline.functions import sequence as seq
from riskline.operators import cohort as co
from riskline.operators import events as ev
from riskline.operators import glm, panel as pn, protocol as pr, quantiles, report, sampling, summary, survival, weights
from riskline.operators.bootstrap import Design
from riskline.operators.lineage import fresh_path, written
from riskline.plans import study as st
from riskline.sources import derived, files
from riskline.sources.schema import CONDITIONS, EVENT_LABELS, PANEL, PANEL_RENAMES, SUBJECT, SUBJECT_RENAMES

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def typed(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        c = F.col(name)
        c = {"i": lambda: c.cast("bigint"), "x": lambda: F.round(c.cast("double"), 6),
             "w": lambda: F.round(c.cast("double"), 3), "d": lambda: c.cast("string"),
             "s": lambda: c}[kind]()
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, spec: str, sql: str | None = None, setup: q.Setup = q.Setup(), more: dict[str, str] | None = None):
    """Register a query; ``sql`` is a FROM clause or a full SELECT over the shared CTEs."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return typed(fn(spark, sf_dir), spec)

        text = None
        if sql is not None:
            select = f"SELECT {q.cols(spec)} FROM ({sql}) AS result" if sql.lstrip().upper().startswith("SELECT") else (
                f"SELECT {q.cols(spec)} FROM {sql}"
            )
            text = q.assemble(select, {**q.ctes(setup), **(more or {})})
        REGISTRY[name] = Entry(run, text)
        return fn

    return register


# ---------------------------------------------------------------- shared steps

STUDY = st.Study(name="derived", cutoff=derived.CUTOFF, periods=derived.PERIODS)
POST = replace(STUDY, window_from=derived.WINDOW_FROM)
SIX = replace(STUDY, refractory_years=0.5)
MAIN_TYPE = replace(STUDY, include_types=(1,), exclude_types=None)
KEEP = replace(STUDY, preserve_boundary_event=True)
# Refractory times of about an interval and a third of one: an interval then has several procedures.
QUARTER, MONTH = replace(STUDY, refractory_years=0.25), replace(STUDY, refractory_years=0.083)
# The study variants that differ from the main one, by the names they are written under.
VARIANTS = {n: replace(s, name=n) for n, s in (("main", STUDY), ("post2010", POST), ("related6mo", SIX), ("colonoscopy", MAIN_TYPE))}
EVERY = derived.PROTOCOL_YEARS
REPS = 10


def subjects(spark, sf):
    return derived.subjects(spark, sf)


def procedures(spark, sf):
    return derived.procedures(spark, sf)


def cohort(spark, sf, study=STUDY):
    return st.study_cohort(study, subjects(spark, sf))


def panel(spark, sf, study=STUDY):
    return st.study_panel(study, subjects(spark, sf), procedures(spark, sf))


_PANELS: dict[tuple, DataFrame] = {}


def panel_table(spark, sf):
    """The study panel as analyses read it: written anew whenever the files it comes from are others."""
    files_read = derived.table(spark, sf, "customer").select("_metadata").union(derived.table(spark, sf, "orders").select("_metadata"))
    state = files_read.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, tuple(sorted(map(tuple, state))))
    if key not in _PANELS:
        _PANELS.clear()
        _PANELS[key] = written(panel(spark, sf), "panel")
    return _PANELS[key]


def rows(spark, sf, every=EVERY, tolerance=0.25):
    return pr.apply_protocol(panel_table(spark, sf), every, tolerance, derived.PERIODS)


def base(spark, sf):
    return rows(spark, sf).where("int = 1")


def yearly(spark, sf):
    people = co.four_state_event(cohort(spark, sf)).select("bene_id", "event4")
    return pr.apply_age_band_protocol(pn.yearly_panel(panel_table(spark, sf), people), derived.PERIODS)


# ---------------------------------------------------------------- scalar functions


@query(
    "date_functions",
    "bene_id:s strict6:d clamp6:d plus_days:d mean_months:d years_fwd:x quarters_fwd:x months_fwd:x years_back:x "
    "quarters_back:x idx:i days:i y:i m:i dd:i us:d iso:d leap:d",
    f"""SELECT bene_id, {q.strict('start_date', 6)} AS strict6, {q.addm('start_date', 6)} AS clamp6,
      end_date + 1 AS plus_days, start_date + CAST(floor(9 * 30.4375) AS INTEGER) AS mean_months,
      {q.div('dob', 'start_date', 12)} AS years_fwd, {q.div('start_date', 'end_date', 3)} AS quarters_fwd,
      {q.div('start_date', 'end_date', 1)} AS months_fwd, {q.div('end_date', 'dob', 12)} AS years_back,
      {q.div('end_date', 'start_date', 3)} AS quarters_back,
      floor({q.div('start_date', 'end_date', 3)}) + 1 AS idx, end_date - start_date AS days,
      year(dob) AS y, month(dob) AS m, day(dob) AS dd, start_date AS us, end_date AS iso,
      CASE WHEN month(dob) = 2 AND day(dob) = 29 THEN dob - 1 ELSE dob END AS leap FROM subject""",
)
def date_functions(spark, sf):
    s, e, b = F.col("start_date"), F.col("end_date"), F.col("dob")
    return subjects(spark, sf).select(
        "bene_id",
        cal.add_months_strict(s, 6).alias("strict6"),
        F.add_months(s, 6).alias("clamp6"),
        F.date_add(e, 1).alias("plus_days"),
        cal.add_month_durations(s, 9).alias("mean_months"),
        cal.calendar_div(b, s, 12).alias("years_fwd"),
        cal.calendar_div(s, e, 3).alias("quarters_fwd"),
        cal.calendar_div(s, e, 1).alias("months_fwd"),
        cal.calendar_div(e, b, 12).alias("years_back"),
        cal.calendar_div(e, s, 3).alias("quarters_back"),
        cal.interval_index(s, e).alias("idx"),
        F.datediff(e, s).alias("days"),
        F.year(b).alias("y"), F.month(b).alias("m"), F.dayofmonth(b).alias("dd"),
        cal.us_date(F.date_format(s, "MM-dd-yyyy")).alias("us"),
        cal.iso_date_prefix(F.concat(e.cast("string"), F.lit(" 00:00:00"))).alias("iso"),
        cal.recode_leap_day(b).alias("leap"),
    )


@query(
    "text_functions",
    "event_id:i fixed:s ci:s clipped:x capped:i rest:x sign_rest:x",
    """SELECT event_id, printf('%.1f', round(value, 1)) AS fixed,
      concat('(', printf('%.1f', round(value, 1)), ', ', printf('%.1f', round(value + 10, 1)), ')') AS ci,
      CASE WHEN value - 50 < 0 THEN 0.0 ELSE value - 50 END AS clipped,
      CASE WHEN user_id > 2 THEN 2 ELSE user_id END AS capped, value - floor(value) AS rest,
      (value - 50) - floor(value - 50) AS sign_rest FROM events""",
)
def text_functions(spark, sf):
    v = F.col("value")
    return derived.table(spark, sf, "events").select(
        "event_id",
        ex.fixed_decimals(v, 1).alias("fixed"),
        ex.interval_text(v, v + 10, 1).alias("ci"),
        ex.clip_lower(v - 50).alias("clipped"),
        ex.cap_count(F.col("user_id")).alias("capped"),
        F.pmod(v, F.lit(1.0)).alias("rest"),
        F.pmod(v - 50, F.lit(1.0)).alias("sign_rest"),
    )


# ---------------------------------------------------------------- cohort


@query("eligible_cohort", "bene_id:s dob:d baseline:d end_date:d min_age_date:d exposed:i", "elig")
def eligible_cohort(spark, sf):
    return co.eligible(co.with_baseline(subjects(spark, sf), derived.CUTOFF))


@query("first_event", "bene_id:s event_date:d first_event:s", "SELECT *, kind AS first_event FROM ev")
def first_event(spark, sf):
    return co.with_first_event(eligible_cohort(spark, sf))


@query("exclude_within", "bene_id:s first_event:s event_date:d", "co0")
def exclude_within(spark, sf):
    return co.exclude_if_within(first_event(spark, sf))


@query("event_index", "bene_id:s age_base:i yr_base:i event_time:x event_int:i", "cohort")
def event_index(spark, sf):
    return cohort(spark, sf)


@query(
    "study_window", "bene_id:s baseline:d event_date:d exposed:i event_time:x event_int:i first_event:s", "cohort",
    q.Setup(window=True),
)
def study_window(spark, sf):
    return cohort(spark, sf, POST)


@query("condition_onset", "bene_id:s " + " ".join(f"onset_{c}:i" for c in CONDITIONS), "onsets")
def condition_onset(spark, sf):
    return co.with_condition_onsets(cohort(spark, sf))


@query("cohort_ids", "bene_id:s", "SELECT DISTINCT bene_id FROM procs WHERE bene_id IN (SELECT bene_id FROM cohort)")
def cohort_ids(spark, sf):
    ids = co.distinct_ids(cohort(spark, sf))
    return co.distinct_ids(co.restrict_to(ev.procedure_filter(procedures(spark, sf), exclude=(3,)), ids))


# ---------------------------------------------------------------- procedures


@query("procedure_filter", "bene_id:s proc_type:i proc_date:d", "SELECT * FROM procedure_all WHERE proc_type = 1")
def procedure_filter(spark, sf):
    return ev.procedure_filter(procedures(spark, sf), include=(1,))


@query("attach_enrollment", "bene_id:s proc_date:d proc_type:i min_age_date:d", "enrolled")
def attach_enrollment(spark, sf):
    return ev.attach_enrollment(ev.procedure_filter(procedures(spark, sf), exclude=(3,)), cohort(spark, sf))


@query("prior_procedure_ids", "bene_id:s", "prior")
def prior_procedure_ids(spark, sf):
    return ev.prior_procedure_ids(attach_enrollment(spark, sf))


@query("prior_proc_excluded", "bene_id:s proc_date:d proc_type:i", "unprior")
def prior_proc_excluded(spark, sf):
    enrolled = attach_enrollment(spark, sf)
    return co.exclude(enrolled, ev.prior_procedure_ids(enrolled))


def _thin(years: float):
    return lambda spark, sf: ev.thin_events(ev.procedure_filter(procedures(spark, sf), exclude=(3,)), years=years)


for _name, _years in (("thin_events_1y", 1.0), ("thin_events_6m", 0.5)):
    query(_name, "bene_id:s proc_date:d proc_type:i", "thinned", more=q.thinning("thinned", "procs", _years))(_thin(_years))


@query(
    "thin_user_events", "bene_id:i proc_date:d proc_type:i", "thinned",
    more={
        "user_days": "SELECT user_id AS bene_id, CAST(ts AS DATE) AS proc_date, length(event_type) AS proc_type FROM events",
        **q.thinning("thinned", "user_days", 0.02),
    },
)
def thin_user_events(spark, sf):
    log = derived.table(spark, sf, "events").withColumn("size", F.length("event_type"))
    return ev.thin_events(log, "user_id", "ts", "size", 0.02).withColumnsRenamed(
        {"user_id": "bene_id", "ts": "proc_date", "size": "proc_type"}
    )


@query("proc_index", "bene_id:s proc_date:d proc_type:i proc_time:x int:i t_between:x", "kept2")
def proc_index(spark, sf):
    kept = ev.thin_events(prior_proc_excluded(spark, sf).select("bene_id", "proc_date", "proc_type"))
    return ev.index_events(kept, cohort(spark, sf))


# ---------------------------------------------------------------- panel

_PANEL_SPEC = (
    "bene_id:s dob:d baseline:d end_date:d exposed:i age_base:i yr_base:i first_elig_state:s race:i sex:s first_event:s "
    "event_date:d event_time:x event_int:i int:i drop:i int_start:d age_start:x int_end:d age_end:x n_cond:i proc_type:i "
    "proc_time:x proc:i date_last_proc:d years_since_proc:x prior_proc:i"
)

for _name, _study, _setup in (
    ("panel_full", STUDY, q.Setup()),
    ("panel_post_window", POST, q.Setup(window=True)),
    ("panel_six_months", SIX, q.Setup(years=0.5)),
    ("panel_three_months", QUARTER, q.Setup(years=0.25)),
    ("panel_one_month", MONTH, q.Setup(years=0.083)),
    ("panel_main_type", MAIN_TYPE, q.Setup(types="proc_type = 1")),
    ("panel_boundary_event", KEEP, q.Setup(preserve=True)),
):
    query(_name, _PANEL_SPEC, "panel", _setup)(partial(panel, study=_study))


@query("expand_intervals", "bene_id:s int:i int_start:d event_int:i", "SELECT * FROM b1")
def expand_intervals(spark, sf):
    """Every interval up to the event interval, before empty ones are dropped."""
    people = cohort(spark, sf).withColumns({"n_int": F.col("event_int"), "n_drop": F.lit(0)})
    return pn.expand_intervals(people)


@query("interval_bounds", "bene_id:s int:i int_start:d int_end:d age_start:x age_end:x", "b5")
def interval_bounds(spark, sf):
    return pn.with_interval_bounds(expand_intervals(spark, sf))


@query(
    "degenerate_drop", "bene_id:s event_int:i n_int:i",
    "SELECT bene_id, max(event_int) AS event_int, count(*) AS n_int FROM b7 GROUP BY bene_id",
)
def degenerate_drop(spark, sf):
    people = pn.with_interval_count(cohort(spark, sf), derived.CUTOFF)
    return people.select("bene_id", "event_int", "n_int")


@query("condition_flags", "bene_id:s int:i n_cond:i", "SELECT * FROM b8")
def condition_flags(spark, sf):
    people = pn.with_interval_count(cohort(spark, sf), derived.CUTOFF).withColumn("n_drop", F.lit(0))
    return pn.with_condition_count(pn.expand_intervals(people))


@query(
    "condition_flag_columns", "bene_id:s int:i " + " ".join(f"cond_{c}:i" for c in CONDITIONS),
    "SELECT bene_id, int, " + ", ".join(f"CASE WHEN int >= onset_{c} THEN 1 ELSE 0 END AS cond_{c}" for c in CONDITIONS)
    + " FROM b7",
)
def condition_flag_columns(spark, sf):
    people = pn.with_interval_count(condition_onset(spark, sf), derived.CUTOFF).withColumn("n_drop", F.lit(0))
    flags = {f"cond_{c}": pn.flag_onset(F.col("int"), F.col(f"onset_{c}")) for c in CONDITIONS}
    return pn.expand_intervals(people).withColumns(flags)


@query(
    "dropout_rows", "bene_id:s int:i int_start:d int_end:d age_start:x age_end:x n_cond:i",
    "SELECT * FROM dropped WHERE bene_id NOT IN (SELECT bene_id FROM prior)",
)
def dropout_rows(spark, sf):
    return panel(spark, sf).where("drop = 1")


@query("last_proc_carry", "bene_id:s int:i proc:i date_last_proc:d prior_proc:i", "panel")
def last_proc_carry(spark, sf):
    """The date carried forward by windows from the procedures of earlier intervals."""
    study = STUDY
    rows = pn.panel_rows(
        cohort(spark, sf), st.study_procedures(study, procedures(spark, sf)), study.cutoff, study.refractory_years, study.months, study.age_cap
    ).select("bene_id", "int", "proc", "proc_date")
    w = seq.by_person("int")
    carried = seq.carry_forward_excluding(F.col("proc_date"), F.col("proc") == 1, w)
    return rows.withColumn("date_last_proc", carried).withColumn("prior_proc", F.col("date_last_proc").isNotNull().cast("int"))


@query("years_since_last", "bene_id:s int:i years_since_proc:x", "panel")
def years_since_last(spark, sf):
    return panel(spark, sf).select("bene_id", "int", "years_since_proc")


@query(
    "strata_split", "race:i sex:s n:i people:i age_sum:x",
    """SELECT race, sex, count(*) AS n, count(DISTINCT bene_id) AS people, sum(age_start) AS age_sum FROM panel
      WHERE race IN (1, 2, 3) GROUP BY race, sex""",
)
def strata_split(spark, sf):
    """Panel written by stratum and read back folder by folder."""
    root = fresh_path(spark, "strata")
    files.write_strata(panel(spark, sf), root)
    parts = [files.read_stratum(spark, root, "race", r) for r in (1, 2, 3)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    people = union.groupBy("race", "sex", "bene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("age_start").alias("age"))
    return people.groupBy("race", "sex").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("people"), F.sum("age").alias("age_sum")
    )


@query("read_panel_stratum", "bene_id:s int:i race:i sex:s age_start:x", "SELECT * FROM panel WHERE sex = 'F'")
def read_panel_stratum(spark, sf):
    root = fresh_path(spark, "panel")
    files.write_panel(panel(spark, sf), root, "main")
    return files.read_panel(spark, root, "main", ("sex", "F"))


@query("stratum_race", "bene_id:s int:i race:i n_cond:i", "SELECT * FROM panel WHERE race = 2")
def stratum_race(spark, sf):
    return st.stratum_panel(panel_table(spark, sf), "race", 2)


@query(
    "read_subjects_csv", " ".join(f"{f.name}:{'d' if f.dataType.typeName() == 'date' else 's' if f.dataType.typeName() == 'string' else 'i'}" for f in SUBJECT),
    "subject",
)
def read_subjects_csv(spark, sf):
    path = fresh_path(spark, "subjects")
    raw = {ours: theirs for theirs, ours in SUBJECT_RENAMES.items()}
    files.write_result(subjects(spark, sf).withColumnsRenamed(raw), path, "csv")
    return files.read_subjects(spark, path)


@query("read_procedures_csv", "bene_id:s proc_type:i proc_date:d", "procedure_all")
def read_procedures_csv(spark, sf):
    path = fresh_path(spark, "procedures")
    files.write_result(procedures(spark, sf), path, "csv")
    return files.read_procedures(spark, path)


@query("panel_csv_roundtrip", _PANEL_SPEC, "panel")
def panel_csv_roundtrip(spark, sf):
    path = fresh_path(spark, "panelcsv")
    files.write_result(panel(spark, sf), path, "csv")
    return files.read_result(spark, path, PANEL, "csv")


@query("read_panel_csv", _PANEL_SPEC, "panel")
def read_panel_csv(spark, sf):
    """The panel from a file with its own column names and event labels."""
    path = fresh_path(spark, "panelfile")
    label = F.create_map(*[F.lit(x) for pair in ((v, k) for k, v in EVENT_LABELS.items()) for x in pair])
    theirs = panel(spark, sf).withColumn("first_event", F.coalesce(label[F.col("first_event")], "first_event"))
    files.write_result(theirs.withColumnsRenamed({v: k for k, v in PANEL_RENAMES.items()}), path, "csv")
    return files.read_panel_csv(spark, path)


def _variant(name: str):
    def run(spark, sf):
        root = fresh_path(spark, "variants")
        files.write_panel(panel(spark, sf, VARIANTS[name]), root, name)
        return files.read_panel(spark, root, name)

    return run


for _name, _setup in (
    ("main", q.Setup()), ("post2010", q.Setup(window=True)), ("related6mo", q.Setup(years=0.5)), ("colonoscopy", q.Setup(types="proc_type = 1")),
):
    query(f"variant_{_name}", _PANEL_SPEC, "panel", _setup)(_variant(_name))


@query("sex_strata", _PANEL_SPEC, "SELECT * FROM panel WHERE sex IN ('M', 'F')")
def sex_strata(spark, sf):
    """Both strata by sex, each read from its own folder."""
    root = fresh_path(spark, "strata")
    files.write_strata(panel(spark, sf), root, ("sex",))
    return files.read_stratum(spark, root, "sex", "M").unionByName(files.read_stratum(spark, root, "sex", "F"))


@query("panel_in_order", "bene_id:s int:i place:i", "SELECT *, row_number() OVER (ORDER BY bene_id, int) AS place FROM panel")
def panel_in_order(spark, sf):
    """The panel written in order, with the place of each row as the files give it when read one after the other."""
    path = fresh_path(spark, "ordered")
    files.write_result(panel(spark, sf), path, order=("bene_id", "int"))
    return files.with_place(spark.read.schema(PANEL).parquet(path), "place")


# ---------------------------------------------------------------- protocol

query("adherence_def2", "bene_id:s int:i screen:i", "rows")(rows)
query("adherence_def10", "bene_id:s int:i screen:i", "rows", q.Setup(every=10))(partial(rows, every=10))
query("adherence_no_tolerance", "bene_id:s int:i screen:i cum_screen:i", "rows", q.Setup(tol=0))(partial(rows, tolerance=0))
query("cum_adherence", "bene_id:s int:i screen_1:i screen_2:i cum_screen:i", "rows")(rows)
query("lag_covariates", "bene_id:s int:i n_cond:i n_cond_1:i n_cond_2:i", "rows")(rows)
query("enroll_period", "bene_id:s enroll_period:i", "base")(base)
query("outcome_code", "bene_id:s int:i event:i", "rows")(rows)
query(
    "adherence_age_band", "bene_id:s age:i proc:i cum_proc:i screen:i screen_1:i screen_2:i cum_screen:i event:i n_cond:i "
    "n_cond_1:i n_cond_2:i", "years",
)(yearly)


@query(
    "first_deviation", "exposed:i age_int:i deviate:i n:i",
    """SELECT exposed, floor(age_start) AS age_int, 1 - screen AS deviate, count(*) AS n FROM (
      SELECT *, sum(cum_dev) OVER (PARTITION BY bene_id ORDER BY int) AS cum_cum FROM (
        SELECT *, sum(1 - screen) OVER (PARTITION BY bene_id ORDER BY int) AS cum_dev FROM rows))
      WHERE cum_cum <= 1 GROUP BY ALL""",
)
def first_deviation(spark, sf):
    return pr.first_deviation(rows(spark, sf))


# ---------------------------------------------------------------- sampling

_U = q.uniform(123, "bene_id")


@query(
    "sample_persons", "bene_id:s int:i exposed:i wt_s:x",
    f"SELECT *, CASE WHEN exposed = 1 THEN 1.0 ELSE 4.0 END AS wt_s FROM panel WHERE exposed = 1 OR {_U} < 0.25",
)
def sample_persons(spark, sf):
    return st.sampled_panel(panel_table(spark, sf))


_STEPS = sampling.poisson_thresholds()
_COPIES = {
    "reps": "SELECT * FROM (VALUES "
    + ", ".join(f"({r}, {a}, {c}, {b})" for r, a, c, b in sampling.replicate_coefficients(REPS, 1))
    + ") AS t(rep, a, c, b)",
    "people": "SELECT DISTINCT bene_id FROM rows",
    "words": """SELECT bene_id, CAST('0x' || substr(md5(bene_id), 1, 7) AS BIGINT) AS h1,
      CAST('0x' || substr(md5(bene_id), 8, 7) AS BIGINT) AS h2 FROM people""",
    "draws": f"SELECT rep, bene_id, (CAST(a AS BIGINT) * h1 + CAST(c AS BIGINT) * h2 + b) % {sampling.MODULUS} AS x FROM reps, words",
    "mults": "SELECT rep, bene_id, " + " + ".join(f"CASE WHEN x >= {t} THEN 1 ELSE 0 END" for t in _STEPS) + " AS mult FROM draws",
    "copies": "SELECT r.*, m.rep, m.mult FROM rows r JOIN mults m ON m.bene_id = r.bene_id WHERE m.mult > 0",
}
_SOME_DRAWS = {**_COPIES, "people": "SELECT bene_id FROM base"}


@query("bootstrap_counts", "rep:i bene_id:s mult:i", "SELECT * FROM mults WHERE mult > 0", more=_SOME_DRAWS)
def bootstrap_counts(spark, sf):
    return sampling.with_poisson_counts(base(spark, sf).select("bene_id"), REPS)


@query(
    "bootstrap_multinomial", "rep:i bene_id:s mult:i",
    """SELECT 0 AS rep, bene_id, 1 AS mult FROM base UNION ALL
      SELECT d.rep, i.bene_id, count(*) AS mult FROM picked d JOIN indexed i ON i.idx = d.idx GROUP BY d.rep, i.bene_id""",
    more={
        "indexed": "SELECT bene_id, row_number() OVER (ORDER BY substr(md5(bene_id), 1, 4), bene_id) - 1 AS idx FROM base",
        "slots": "SELECT rep, draw FROM (SELECT unnest(range(1, 6)) AS rep), (SELECT idx AS draw FROM indexed)",
        "picked": f"""SELECT rep, CAST(floor({q.uniform(1, 'rep', 'draw')} * (SELECT count(*) FROM base)) AS BIGINT) AS idx
          FROM slots""",
    },
)
def bootstrap_multinomial(spark, sf):
    ids = written(base(spark, sf).select("bene_id"), "ids")
    return sampling.multinomial_counts(ids, 5)


@query(
    "replicate_rows", "rep:i bid:s int:i",
    "SELECT rep, bene_id || '#' || CAST(k AS VARCHAR) AS bid, int FROM (SELECT *, unnest(range(1, mult + 1)) AS k FROM copies)",
    more=_COPIES,
)
def replicate_rows(spark, sf):
    return sampling.replicate_rows(sampling.with_poisson_counts(rows(spark, sf), REPS))


# ---------------------------------------------------------------- curves

_C2 = {"primary": 1, "competing": 2}
_W_SQL = "(1 + 0.5 * n_cond + 0.25 * race)"
_CRUDE = q.curve_ctes("curve", "rows", "exposed", "age_start", "age_end", "1", _C2)
_WEIGHTED = q.curve_ctes("curve", "rows", "exposed", "age_start", "age_end", _W_SQL, _C2)
_ORIGIN = "UNION ALL SELECT DISTINCT exposed, 50.0, NULL, NULL, NULL, 1.0, 0.0, 0.0 FROM curve"
_CURVE_COLS = "exposed, time, n_risk, n_primary, n_competing, surv, risk_primary, risk_competing"
_CURVE_SPEC = "exposed:i time:x n_risk:x n_primary:x n_competing:x surv:x risk_primary:x risk_competing:x"


def _weight():
    return 1 + 0.5 * F.col("n_cond") + 0.25 * F.col("race")


@query("cif_crude", _CURVE_SPEC, f"SELECT {_CURVE_COLS} FROM curve {_ORIGIN}", more=_CRUDE)
def cif_crude(spark, sf):
    return survival.cumulative_incidence(rows(spark, sf), ["exposed"])


@query("cif_weighted", _CURVE_SPEC, f"SELECT {_CURVE_COLS} FROM curve {_ORIGIN}", more=_WEIGHTED)
def cif_weighted(spark, sf):
    return survival.cumulative_incidence(rows(spark, sf), ["exposed"], weight=_weight())


@query(
    "risk_sets", "exposed:i time:x n_risk:i n_primary:i n_competing:i",
    "SELECT * FROM curve", more=_CRUDE,
)
def risk_sets(spark, sf):
    return survival.risk_sets(rows(spark, sf), ["exposed"]).where("n_primary + n_competing > 0")


_C3 = {"primary": 1, "other": 2, "competing": 3}


@query(
    "cif_three_cause", "exposed:i time:x surv:x risk_primary:x risk_other:x risk_competing:x",
    """SELECT exposed, time, surv, risk_primary, risk_other, risk_competing FROM curve
      UNION ALL SELECT DISTINCT exposed, 18.0, 1.0, 0.0, 0.0, 0.0 FROM curve""",
    more=q.curve_ctes("curve", "years", "exposed", "age - 1", "age", "1", _C3),
)
def cif_three_cause(spark, sf):
    spans = yearly(spark, sf).withColumns({"a": F.col("age") - 1, "b": F.col("age")})
    return survival.cumulative_incidence(spans, ["exposed"], "a", "b", causes=_C3, origin=18.0)


def _aligned_sql(by: str, times: str, source: str = "curve", origin: str = "50.0") -> dict[str, str]:
    """CTE ``aligned``: last step of each curve at or before each time, by as-of lookup."""
    on = f"{by}, " if by else ""
    pick = lambda s, c: (
        f"coalesce((SELECT arg_max(c.risk_{c}, c.time) FROM {source} c WHERE c.exposed = {s} AND c.time <= g.time"
        + (f" AND c.{by} = g.{by}" if by else "") + "), 0.0)"
    )
    parts = ", ".join(f"{pick(s, c)} AS risk_{c}{s}" for s in (0, 1) for c in _C2)
    first = f"SELECT DISTINCT {on}{origin} AS time FROM {source}"
    contrast = ", ".join(
        f"risk_{c}1 - risk_{c}0 AS rd_{c}, CASE WHEN risk_{c}0 <> 0 THEN risk_{c}1 / risk_{c}0 "
        f"WHEN risk_{c}1 <> 0 THEN CAST('inf' AS DOUBLE) END AS rr_{c}" for c in _C2
    )
    return {
        "times": f"SELECT DISTINCT {on}time FROM {source} {times} UNION {first}",
        "aligned": f"SELECT g.*, {parts} FROM times g",
        "contrasted": f"SELECT *, {contrast} FROM aligned",
    }


_ALIGN_SPEC = "time:x risk_primary0:x risk_competing0:x risk_primary1:x risk_competing1:x"


@query("align_asof", _ALIGN_SPEC, "aligned", more={**_CRUDE, **_aligned_sql("", "")})
def align_asof(spark, sf):
    return survival.align_curves(cif_crude(spark, sf), mode="asof")


@query(
    "align_full", _ALIGN_SPEC,
    f"""SELECT time, {', '.join(f'last_value({c} IGNORE NULLS) OVER (ORDER BY time) AS {c}' for c in
      ('risk_primary0', 'risk_competing0', 'risk_primary1', 'risk_competing1'))} FROM joined""",
    more={
        **_CRUDE,
        "c0": "SELECT time, risk_primary AS risk_primary0, risk_competing AS risk_competing0 FROM curve WHERE exposed = 0 "
        "UNION ALL SELECT 50.0, 0.0, 0.0",
        "c1": "SELECT time, risk_primary AS risk_primary1, risk_competing AS risk_competing1 FROM curve WHERE exposed = 1 "
        "UNION ALL SELECT 50.0, 0.0, 0.0",
        "joined": "SELECT * FROM c0 FULL JOIN c1 USING (time)",
    },
)
def align_full(spark, sf):
    return survival.align_curves(cif_crude(spark, sf), mode="full")


@query(
    "align_exact", _ALIGN_SPEC,
    """SELECT time, risk_primary0, risk_competing0, last_value(risk_primary1 IGNORE NULLS) OVER (ORDER BY time) AS risk_primary1,
      last_value(risk_competing1 IGNORE NULLS) OVER (ORDER BY time) AS risk_competing1 FROM c0 LEFT JOIN c1 USING (time)""",
    more={
        **_CRUDE,
        "c0": "SELECT time, risk_primary AS risk_primary0, risk_competing AS risk_competing0 FROM curve WHERE exposed = 0 "
        "UNION ALL SELECT 50.0, 0.0, 0.0",
        "c1": "SELECT time, risk_primary AS risk_primary1, risk_competing AS risk_competing1 FROM curve WHERE exposed = 1 "
        "UNION ALL SELECT 50.0, 0.0, 0.0",
    },
)
def align_exact(spark, sf):
    return survival.align_curves(cif_crude(spark, sf), mode="exact_left")


@query(
    "curves_wide", _ALIGN_SPEC,
    f"""SELECT time, {', '.join(f'max(CASE WHEN exposed = {s} THEN risk_{c} END) AS risk_{c}{s}' for s in (0, 1) for c in _C2)}
      FROM (SELECT {_CURVE_COLS} FROM curve {_ORIGIN}) GROUP BY time""",
    more=_CRUDE,
)
def curves_wide(spark, sf):
    return survival.curves_wide(cif_crude(spark, sf))


@query(
    "contrast", "time:x rd_primary:x rr_primary:x rd_competing:x rr_competing:x", "contrasted",
    more={**_WEIGHTED, **_aligned_sql("", "")},
)
def contrast(spark, sf):
    return survival.contrast(survival.align_curves(cif_weighted(spark, sf)))


@query(
    "tidy_curve", "exposed:i time:x state:i estimate:x",
    """SELECT exposed, time, 1 AS state, risk_primary AS estimate FROM curve
      UNION ALL SELECT exposed, time, 2, risk_competing FROM curve""",
    more=_CRUDE,
)
def tidy_curve(spark, sf):
    return survival.tidy_curve(survival.cumulative_incidence(rows(spark, sf), ["exposed"], origin=None))


_ROBUST = {
    **_CRUDE,
    "hz": "SELECT *, (n_primary + n_competing) / n_risk AS h, n_primary / n_risk AS h1, n_competing / n_risk AS h2 FROM curve",
    "pairs": """SELECT r.bene_id, z.exposed, z.time, z.n_risk, z.h, z.h1, z.h2, z.before, z.risk_primary, z.risk_competing,
        max(CASE WHEN r.age_start < z.time AND z.time <= r.age_end THEN 1 ELSE 0 END) AS live,
        max(CASE WHEN r.age_end = z.time THEN r.event ELSE 0 END) AS ev
      FROM rows r JOIN hz z ON z.exposed = r.exposed GROUP BY ALL""",
    "steps": """SELECT *, CASE WHEN h < 1 THEN ((CASE WHEN ev > 0 THEN 1 ELSE 0 END) - live * h) / (n_risk * (1 - h)) ELSE 0 END AS da,
        before * ((CASE WHEN ev = 1 THEN 1 ELSE 0 END) - live * h1) / n_risk AS j1,
        before * ((CASE WHEN ev = 2 THEN 1 ELSE 0 END) - live * h2) / n_risk AS j2 FROM pairs""",
    "infl": """SELECT *, sum(da) OVER w AS qq, sum(da * risk_primary + j1) OVER w AS p1, sum(da * risk_competing + j2) OVER w AS p2
      FROM steps WINDOW w AS (PARTITION BY bene_id, exposed ORDER BY time)""",
    "sds": """SELECT exposed, time, any_value(risk_primary) AS risk_primary, any_value(risk_competing) AS risk_competing,
        sqrt(sum((p1 - risk_primary * qq) * (p1 - risk_primary * qq))) AS se_primary,
        sqrt(sum((p2 - risk_competing * qq) * (p2 - risk_competing * qq))) AS se_competing FROM infl GROUP BY exposed, time""",
}
_Z = "1.959963984540054"


def _loglog_sql(c: str) -> str:
    r = f"risk_{c}"
    inner = f"ln(-ln({r})) {{0}} {_Z} * se_{c} / ({r} * ln({r}))"
    ok = f"CASE WHEN {r} > 0 AND {r} < 1 THEN"
    return (
        f"{ok} exp(-exp({inner.format('-')})) END AS lower_{c}, {ok} exp(-exp({inner.format('+')})) END AS upper_{c}"
    )


@query(
    "cif_robust_ci",
    "exposed:i time:x risk_primary:x se_primary:x lower_primary:x upper_primary:x risk_competing:x se_competing:x "
    "lower_competing:x upper_competing:x",
    f"SELECT *, {_loglog_sql('primary')}, {_loglog_sql('competing')} FROM sds", more=_ROBUST,
)
def cif_robust_ci(spark, sf):
    return survival.robust_incidence(rows(spark, sf))


# ---------------------------------------------------------------- models and weights


@query(
    "marginal_prob", "rep:i p_marginal:x", "SELECT 0 AS rep, avg(exposed) AS p_marginal FROM base",
)
def marginal_prob(spark, sf):
    return glm.marginal_prob(base(spark, sf).withColumn("rep", F.lit(0)), "exposed", F.lit(1))


@query(
    "cubic_basis", "bene_id:s b1:x b2:x b3:x",
    """SELECT bene_id, 3*u*(1-u)*(1-u) AS b1, 3*u*u*(1-u) AS b2, u*u*u AS b3
      FROM (SELECT bene_id, (age_start - 50) / 20 AS u FROM base)""",
)
def cubic_basis(spark, sf):
    names = zip(glm.cubic_basis(F.col("age_start"), 50.0, 70.0), ("b1", "b2", "b3"))
    return base(spark, sf).select("bene_id", *[c.alias(n) for c, n in names])


def _fit_frame(spark, sf, name, source=base):
    df = source(spark, sf).withColumns({"rep": F.lit(0), "freq": F.lit(1)})
    return written(glm.cells(df, ["rep", "exposed", "race", "sex", "screen", "screen_1", "enroll_period", "age_start"],
                             {"freq": F.lit(1)}), name)


@query(
    "saturated_ipw", "bene_id:s wt_exposure:x",
    """SELECT bene_id, CASE WHEN exposed = 1 THEN m / p ELSE (1 - m) / (1 - p) END AS wt_exposure FROM (
      SELECT *, avg(exposed) OVER () AS m, avg(exposed) OVER (PARTITION BY race) AS p FROM base)""",
)
def saturated_ipw(spark, sf):
    """Exposure weight with race as the only covariate: the fitted values are group means."""
    table = _fit_frame(spark, sf, "saturated")
    model = glm.Logit("exposure", "exposed", (glm.Category("race", (1, 2, 3)),))
    beta = glm.fit_logits(table, [model])[("exposure", 0)]
    p = glm.fitted(model.terms, F.array(*[F.lit(float(b)) for b in beta]))
    m = F.lit(table.agg(F.sum(F.col("exposed") * F.col("freq")) / F.sum("freq")).first()[0])
    return base(spark, sf).select("bene_id", weights.exposure_weight(m, p).alias("wt_exposure"))


@query(
    "saturated_adherence", "exposed:i screen_1:i p:x",
    "SELECT exposed, screen_1, avg(screen) AS p FROM rows GROUP BY exposed, screen_1",
)
def saturated_adherence(spark, sf):
    """Adherence on its first lag, one model per exposure stratum: fitted values are group means."""
    table = _fit_frame(spark, sf, "lag", source=rows)
    model = glm.Logit("lag", "screen", (glm.Numeric("screen_1"),), by=("rep", "exposed"))
    beta = glm.fit_logits(table, [model])
    groups = table.select("exposed", "screen_1").distinct()
    p = {s: glm.fitted(model.terms, F.array(*[F.lit(float(b)) for b in beta[("lag", 0, s)]])) for s in (0, 1)}
    return groups.withColumn("p", F.when(F.col("exposed") == 1, p[1]).otherwise(p[0]))


@query("logit_fit", "bene_id:s p:x")
def logit_fit(spark, sf):
    """Fitted exposure probabilities of the full baseline model."""
    df = base(spark, sf).withColumn("rep", F.lit(0))
    table = written(glm.cells(df, ["rep", "exposed", "age_start", *weights.BASELINE_COVARIATES], {"freq": F.lit(1)}), "logit")
    lv = glm.levels(table, weights.BASELINE_COVARIATES)
    lo, hi = table.agg(F.min("age_start"), F.max("age_start")).first()
    terms = (glm.Spline("age_start", lo, hi), *[glm.Category(c, lv[c]) for c in weights.BASELINE_COVARIATES])
    beta = glm.fit_logits(table, [glm.Logit("exposure", "exposed", terms)])[("exposure", 0)]
    return base(spark, sf).select("bene_id", glm.fitted(terms, F.array(*[F.lit(float(b)) for b in beta])).alias("p"))


@query("ip_weights", "bene_id:s int:i wt_exposure:x wt_screen:x wt_drop:x wt_final:x wt_final_exposure:x")
def ip_weights(spark, sf):
    return st.interval_weights(rows(spark, sf))


_GIVEN_SQL = {
    "given": """SELECT *, 1 + 0.25 * exposed AS wt_exposure, 1 + 0.125 * proc - 0.0625 * n_cond AS wt_screen,
      CASE WHEN drop = 1 THEN 0.0 ELSE 1 + 0.03125 * n_cond END AS wt_drop FROM rows""",
    "cumulated": """SELECT *, product(wt_screen) OVER w AS cum_wt_screen, product(wt_drop) OVER w AS cum_wt_drop
      FROM given WINDOW w AS (PARTITION BY bene_id ORDER BY int)""",
    "final": """SELECT *, cum_screen * wt_exposure * cum_wt_screen * cum_wt_drop AS wt_final,
      wt_exposure * cum_wt_drop AS wt_final_exposure FROM cumulated""",
    "big": "SELECT *, floor(age_start) AS age_year, wt_final * (1 + 40 * proc) * 2 AS wt_big FROM final",
    "capped": """SELECT *, quantile_cont(wt_big, 0.95) FILTER (cum_screen = 1) OVER (PARTITION BY age_year) AS p95 FROM big""",
}


def _given(spark, sf):
    df = rows(spark, sf).withColumns(
        {
            "rep": F.lit(0),
            "wt_exposure": 1 + 0.25 * F.col("exposed"),
            "wt_screen": 1 + 0.125 * F.col("proc") - 0.0625 * F.col("n_cond"),
            "wt_drop": F.when(F.col("drop") == 1, 0.0).otherwise(1 + 0.03125 * F.col("n_cond")),
        }
    )
    return weights.cumulative_weights(df)


def _big(spark, sf):
    return _given(spark, sf).withColumns(
        {"age_year": F.floor("age_start"), "wt_big": F.col("wt_final") * (1 + 40 * F.col("proc")) * 2}
    )


query(
    "cumulative_weights", "bene_id:s int:i cum_wt_screen:x cum_wt_drop:x wt_final:x wt_final_exposure:x", "final",
    more=_GIVEN_SQL,
)(_given)

_SUMMARY_SQL = """SELECT {by}, count(*) AS n, avg(wt_final) AS avg_wt, min(wt_final) AS min_wt, max(wt_final) AS max_wt,
  quantile_cont(wt_final, 0.05) AS p5_wt, quantile_cont(wt_final, 0.95) AS p95_wt FROM big WHERE cum_screen = 1 GROUP BY ALL"""


@query(
    "weight_summary", "age_start:x n:i avg_wt:x min_wt:x p5_wt:x p95_wt:x max_wt:x", _SUMMARY_SQL.format(by="age_start"),
    more=_GIVEN_SQL,
)
def weight_summary(spark, sf):
    return weights.weight_summary(_given(spark, sf), ["age_start"])


@query(
    "weight_summary_by_year", "exposed:i age_year:i n:i avg_wt:x min_wt:x p5_wt:x p95_wt:x max_wt:x",
    _SUMMARY_SQL.format(by="exposed, age_year"), more=_GIVEN_SQL,
)
def weight_summary_by_year(spark, sf):
    return weights.weight_summary(_big(spark, sf), ["exposed", "age_year"])


@query(
    "mean_weight_summary", "age_year:i avg_wt:x min_wt:x max_wt:x",
    "SELECT age_year, avg(wt_big) AS avg_wt, min(wt_big) AS min_wt, max(wt_big) AS max_wt FROM big WHERE cum_screen = 1 GROUP BY 1",
    more=_GIVEN_SQL,
)
def mean_weight_summary(spark, sf):
    return weights.mean_weight_summary(_big(spark, sf), ["age_year"], "wt_big")


@query(
    "overall_weight_stats", " ".join(f"{f}_{c}:x" for c in ("avg_wt", "min_wt", "max_wt") for f in ("mean", "min", "max")),
    "SELECT " + ", ".join(f"{g}({c}) AS {f}_{c}" for c in ("avg_wt", "min_wt", "max_wt") for f, g in (("mean", "avg"), ("min", "min"), ("max", "max")))
    + f" FROM ({_SUMMARY_SQL.format(by='age_start')})",
    more=_GIVEN_SQL,
)
def overall_weight_stats(spark, sf):
    return summary.overall_weight_stats(weight_summary(spark, sf))


@query(
    "truncate_weight", "bene_id:s int:i wt_big:x",
    "SELECT bene_id, int, CASE WHEN wt_big > 100 THEN p95 ELSE wt_big END AS wt_big FROM capped", more=_GIVEN_SQL,
)
def truncate_weight(spark, sf):
    df = _big(spark, sf)
    return weights.truncate_weight(df, weights.weight_summary(df, ["age_year"], "wt_big"), ["age_year"], "wt_big")


@query(
    "exact_quantiles", "o_orderpriority:s q0:x q1:x median:x q99:x",
    """SELECT o_orderpriority, quantile_cont(o_totalprice, 0) AS q0, quantile_cont(o_totalprice, 0.25) AS q1,
      quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.99) AS q99 FROM orders GROUP BY 1""",
)
def exact_quantiles(spark, sf):
    return quantiles.exact_quantiles(
        derived.table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", (0, 0.25, 0.5, 0.99), ("q0", "q1", "median", "q99")
    )


# ---------------------------------------------------------------- bootstrap

_BOOT = {**_COPIES, **q.curve_ctes("curve", "copies", "rep, exposed", "age_start", "age_end", "mult", _C2)}
_BOOT_ALL = {**_BOOT, **_aligned_sql("rep", "")}
_MEASURES = summary.curve_measures()
_BOOT_SPEC = "rep:i time:x " + " ".join(f"{m}:x" for m in _MEASURES)


def boot_curves(spark, sf):
    """Aligned curves of the crude bootstrap: multiplicities as weights."""
    table, counts = sampling.with_draws(rows(spark, sf), REPS)
    curve = st.replicate_curves(written(table, "draws"), counts, Design("count", survival.CAUSES))
    return survival.contrast(survival.align_curves(curve, ["rep"]))


query("bootstrap_curves", _BOOT_SPEC, "contrasted", more=_BOOT_ALL)(boot_curves)

_GRID = {
    **_BOOT_ALL,
    "grid": "SELECT r.rep, t.time FROM reps r, (SELECT DISTINCT time FROM contrasted WHERE rep = 0) t",
    "placed": "SELECT g.rep, g.time, " + ", ".join(f"c.{m}" for m in _MEASURES)
    + " FROM grid g ASOF JOIN contrasted c ON c.rep = g.rep AND c.time <= g.time",
}
_PCT = "SELECT time, " + ", ".join(
    f"quantile_cont({m}, {p}) AS {m}_{t}" for m in _MEASURES for p, t in ((0.025, "ll"), (0.975, "ul"))
)
_PCT_SPEC = " ".join(f"{m}_{t}:x" for m in _MEASURES for t in ("ll", "ul"))


@query("boot_on_grid", _BOOT_SPEC, "placed", more=_GRID)
def boot_on_grid(spark, sf):
    return summary.on_reference_grid(written(boot_curves(spark, sf), "curves"), _MEASURES, REPS)


@query("boot_percentiles", f"time:x {_PCT_SPEC}", f"{_PCT} FROM contrasted GROUP BY time", more=_BOOT_ALL)
def boot_percentiles(spark, sf):
    return summary.boot_percentiles(boot_curves(spark, sf), _MEASURES)


@query(
    "boot_se", "time:x " + " ".join(f"se_{m}:x" for m in _MEASURES if m[:2] != "rr"),
    "SELECT time, " + ", ".join(f"stddev_samp({m}) AS se_{m}" for m in _MEASURES if m[:2] != "rr") + " FROM contrasted GROUP BY time",
    more=_BOOT_ALL,
)
def boot_se(spark, sf):
    return summary.boot_se(boot_curves(spark, sf), [m for m in _MEASURES if m[:2] != "rr"])


_RESULT = {
    **_GRID,
    "pct": f"{_PCT} FROM placed GROUP BY time",
    "res": "SELECT c.*, p.* EXCLUDE (time) FROM contrasted c JOIN pct p ON p.time = c.time WHERE c.rep = 0",
}


def boot_result(spark, sf):
    return summary.summarise_bootstrap(written(boot_curves(spark, sf), "curves"), _MEASURES, REPS)


query("bootstrap_summary", "time:x " + " ".join(f"{m}:x" for m in _MEASURES) + f" {_PCT_SPEC}", "res", more=_RESULT)(boot_result)


@query(
    "bootstrap_summary_exact", "time:x rd_primary:x rd_primary_ll:x rd_primary_ul:x",
    f"SELECT c.*, p.* EXCLUDE (time) FROM contrasted c JOIN ({_PCT} FROM contrasted GROUP BY time) p ON p.time = c.time WHERE rep = 0",
    more=_BOOT_ALL,
)
def bootstrap_summary_exact(spark, sf):
    return summary.summarise_bootstrap(written(boot_curves(spark, sf), "curves"), _MEASURES, REPS, mode="exact")


@query("bootstrap_cif", "time:x " + " ".join(f"{m}:x" for m in _MEASURES) + f" {_PCT_SPEC} n:i avg_wt:x p95_wt:x")
def bootstrap_cif(spark, sf):
    """The whole weighted analysis with bootstrap intervals."""
    return st.weighted_analysis(panel_table(spark, sf), EVERY, reps=4, periods=derived.PERIODS)


@query("exposure_weighted_cif", "time:x " + " ".join(f"{m}:x" for m in _MEASURES))
def exposure_weighted_cif(spark, sf):
    return st.weighted_analysis(panel_table(spark, sf), EVERY, "exposure", periods=derived.PERIODS)


@query("stratum_cif", "time:x " + " ".join(f"{m}:x" for m in _MEASURES))
def stratum_cif(spark, sf):
    """The weighted analysis of one sex, which is then left out of the models."""
    women = st.stratum_panel(panel_table(spark, sf), "sex", "F")
    return st.weighted_analysis(women, EVERY, omit=("sex",), fractions={1: 1.0, 0: 1.0}, periods=derived.PERIODS)


@query(
    "yearly_cif", "time:x rd_primary:x rd_other:x rd_competing:x risk_primary0:x risk_primary1:x",
    """SELECT time, p1 - p0 AS rd_primary, o1 - o0 AS rd_other, d1 - d0 AS rd_competing, p0 AS risk_primary0, p1 AS risk_primary1 FROM (
      SELECT time, """ + ", ".join(
        f"coalesce((SELECT arg_max(risk_{c}, c.time) FROM curve c WHERE exposed = {s} AND c.time <= g.time), 0.0) AS {k}{s}"
        for c, k in (("primary", "p"), ("other", "o"), ("competing", "d")) for s in (0, 1)
    ) + " FROM (SELECT DISTINCT time FROM curve UNION SELECT 18) g)",
    more=q.curve_ctes("curve", "years", "exposed", "age - 1", "age", "1", _C3),
)
def yearly_cif(spark, sf):
    return st.yearly_curves(yearly(spark, sf).withColumns({"rep": F.lit(0), "mult": F.lit(1)}))


@query("yearly_weighted_cif", "time:i rd_primary:x rd_other:x rd_competing:x avg_wt:x min_wt:x max_wt:x")
def yearly_weighted_cif(spark, sf):
    weighted = written(st.yearly_weights(yearly(spark, sf)), "yearly-weighted")
    return st.yearly_curves(weighted, weighted=True)


# ---------------------------------------------------------------- weighted analyses with models that SQL can state

# With one category per model the fitted values are group means.
_ONE_EACH = {
    "exposure": (glm.Category("sex", ("F", "M")),),
    "adherence_num": (glm.Numeric("screen_1"),),
    "adherence_den": (glm.Category("enroll_period", (1, 2, 3)),),
    "stay_num": (glm.Numeric("screen"),),
    "stay_den": (glm.Category("sex", ("F", "M")),),
}


def _one_each(spark, sf):
    """The same terms, with the enrolment periods that occur."""
    lv = glm.levels(rows(spark, sf), ["enroll_period"])
    return {**_ONE_EACH, "adherence_den": (glm.Category("enroll_period", lv["enroll_period"]),)}


def _mean(value: str, by: str) -> str:
    return f"sum(mult * {value}) OVER (PARTITION BY {by}) / sum(mult) OVER (PARTITION BY {by})"


def _ipw_sql(source: str) -> dict[str, str]:
    seen = lambda y, p: f"CASE WHEN {y} = 1 THEN {p} ELSE 1 - {p} END"
    return {
        "sat0": f"SELECT *, 1 - drop AS stay FROM ({source})",
        "sat1": f"""SELECT *, {_mean('screen', 'rep, exposed, screen_1')} AS an, {_mean('screen', 'rep, exposed, enroll_period')} AS ad,
          {_mean('stay', 'rep, exposed, screen')} AS sn, {_mean('stay', 'rep, exposed, sex')} AS sd FROM sat0""",
        "sat2": f"SELECT *, {_mean('exposed', 'rep')} AS em, {_mean('exposed', 'rep, sex')} AS ep FROM sat0 WHERE int = 1",
        "sat3": f"""SELECT s.*, ({seen('s.exposed', 'e.em')}) / ({seen('s.exposed', 'e.ep')}) AS wt_exposure,
          ({seen('screen', 'an')}) / ({seen('screen', 'ad')}) AS wt_screen,
          CASE WHEN stay = 1 THEN sn / sd ELSE 0.0 END AS wt_drop
          FROM sat1 s JOIN (SELECT bene_id, rep, em, ep FROM sat2) e ON e.bene_id = s.bene_id AND e.rep = s.rep""",
        "sat4": """SELECT *, product(wt_screen) OVER w AS cum_wt_screen, product(wt_drop) OVER w AS cum_wt_drop
          FROM sat3 WINDOW w AS (PARTITION BY bene_id, rep ORDER BY int)""",
        "sat": """SELECT *, cum_screen * wt_exposure * cum_wt_screen * cum_wt_drop AS wt_final,
          wt_exposure * cum_wt_drop AS wt_final_exposure FROM sat4""",
    }


_SAT = _ipw_sql("SELECT *, 0 AS rep, 1 AS mult FROM rows")
_SAT_EXPOSURE = {
    **_SAT,
    **q.curve_ctes("curve", "sat", "rep, exposed", "age_start", "age_end", "wt_final_exposure * mult", _C2),
    **_aligned_sql("rep", ""),
}


def _sat_adherence(source: str) -> dict[str, str]:
    return {
        **_ipw_sql(source),
        "repeated": "SELECT rep, age_start, wt_final FROM sat, range(mult) WHERE cum_screen = 1 AND mult > 0",
        "summ": """SELECT rep, age_start, count(*) AS n, avg(wt_final) AS avg_wt, quantile_cont(wt_final, 0.95) AS p95_wt
          FROM repeated GROUP BY ALL""",
        "cut": """SELECT s.* REPLACE (CASE WHEN wt_final > 100 THEN p95_wt ELSE wt_final END AS wt_final)
          FROM sat s JOIN summ m ON m.rep = s.rep AND m.age_start = s.age_start WHERE cum_screen = 1""",
        **q.curve_ctes("curve", "cut", "rep, exposed", "age_start", "age_end", "wt_final * mult", _C2),
        **_aligned_sql("rep", ""),
    }


_ALL = {1: 1.0, 0: 1.0}
_POINT_SPEC = "time:w " + " ".join(f"{m}:w" for m in _MEASURES)


@query("ip_weights_saturated", "bene_id:s int:i wt_exposure:w wt_screen:w wt_drop:w wt_final:w wt_final_exposure:w", "sat", more=_SAT)
def ip_weights_saturated(spark, sf):
    return st.interval_weights(rows(spark, sf), given=_one_each(spark, sf))


@query("exposure_weighted_saturated", _POINT_SPEC, "contrasted", more=_SAT_EXPOSURE)
def exposure_weighted_saturated(spark, sf):
    return st.weighted_analysis(
        panel_table(spark, sf), EVERY, "exposure", fractions=_ALL, periods=derived.PERIODS, given=_one_each(spark, sf)
    )


@query(
    "adherence_weighted_saturated", f"{_POINT_SPEC} n:i avg_wt:w p95_wt:w",
    "SELECT c.*, m.n, m.avg_wt, m.p95_wt FROM contrasted c LEFT JOIN summ m ON m.rep = c.rep AND m.age_start = c.time",
    more=_sat_adherence("SELECT *, 0 AS rep, 1 AS mult FROM rows"),
)
def adherence_weighted_saturated(spark, sf):
    return st.weighted_analysis(panel_table(spark, sf), EVERY, fractions=_ALL, periods=derived.PERIODS, given=_one_each(spark, sf))


@query(
    "stratum_race_saturated", _POINT_SPEC, "contrasted",
    more=_sat_adherence("SELECT *, 0 AS rep, 1 AS mult FROM rows WHERE race = 2"),
)
def stratum_race_saturated(spark, sf):
    """The weighted analysis of one race, which is left out of the models."""
    some = st.stratum_panel(panel_table(spark, sf), "race", 2)
    return st.weighted_analysis(
        some, EVERY, omit=("race",), fractions=_ALL, periods=derived.PERIODS, given=_one_each(spark, sf)
    )


@query(
    "bootstrap_cif_saturated", "time:w " + " ".join(f"{m}:w" for m in _MEASURES) + " " + " ".join(f"{m}_{t}:w" for m in _MEASURES for t in ("ll", "ul")),
    "SELECT c.*, p.* EXCLUDE (time) FROM contrasted c JOIN pct p ON p.time = c.time WHERE c.rep = 0",
    more={**_COPIES, **_sat_adherence("copies"), **{k: _GRID[k] for k in ("grid", "placed")}, "pct": f"{_PCT} FROM placed GROUP BY time"},
)
def bootstrap_cif_saturated(spark, sf):
    """The whole weighted analysis with bootstrap intervals, models refitted in every replicate."""
    return st.weighted_analysis(
        panel_table(spark, sf), EVERY, reps=REPS, fractions=_ALL, seed=1, periods=derived.PERIODS, given=_one_each(spark, sf)
    )


_PCT_ROWS = {**{k: _GRID[k] for k in ("grid", "placed")}, "pct": f"{_PCT} FROM placed GROUP BY time"}
_BOOTED_SPEC = "time:w " + " ".join(f"{m}:w" for m in _MEASURES) + " " + " ".join(f"{m}_{t}:w" for m in _MEASURES for t in ("ll", "ul"))
_BOOTED = "SELECT c.*, p.* EXCLUDE (time) FROM contrasted c JOIN pct p ON p.time = c.time WHERE c.rep = 0"


@query(
    "bootstrap_exposure_saturated", _BOOTED_SPEC, _BOOTED,
    more={
        **_COPIES, **_ipw_sql("copies"), **q.curve_ctes("curve", "sat", "rep, exposed", "age_start", "age_end", "wt_final_exposure * mult", _C2),
        **_aligned_sql("rep", ""), **_PCT_ROWS,
    },
)
def bootstrap_exposure_saturated(spark, sf):
    """The exposure-weighted analysis with bootstrap intervals."""
    return st.weighted_analysis(
        panel_table(spark, sf), EVERY, "exposure", reps=REPS, fractions=_ALL, seed=1, periods=derived.PERIODS, given=_one_each(spark, sf)
    )


@query("bootstrap_multinomial_cif", "time:x " + " ".join(f"{m}:x" for m in _MEASURES) + f" {_PCT_SPEC}")
def bootstrap_multinomial_cif(spark, sf):
    """The weighted analysis with resamples of n from n people."""
    return st.weighted_analysis(panel_table(spark, sf), EVERY, reps=4, method="multinomial", periods=derived.PERIODS)


@query(
    "result_weight_stats", " ".join(f"{n}_{c}:w" for c in ("avg_wt", "min_wt", "max_wt") for n in ("mean", "min", "max")),
    "SELECT " + ", ".join(f"{f}({c}) AS {n}_{c}" for c in ("avg_wt", "min_wt", "max_wt") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
    + " FROM contrasted c LEFT JOIN summ3 m ON m.rep = c.rep AND m.age_start = c.time",
    more={
        **_sat_adherence("SELECT *, 0 AS rep, 1 AS mult FROM rows"),
        "summ3": "SELECT rep, age_start, avg(wt_final) AS avg_wt, min(wt_final) AS min_wt, max(wt_final) AS max_wt FROM repeated GROUP BY ALL",
    },
)
def result_weight_stats(spark, sf):
    """Weight statistics over the rows of a result."""
    return summary.overall_weight_stats(adherence_weighted_saturated(spark, sf))


_SCORES = {
    "exposure": ("exposed", "WHERE int = 1", "NULL"),
    "adherence_num": ("screen", "", "exposed"), "adherence_den": ("screen", "", "exposed"),
    "stay_num": ("1 - drop", "", "exposed"), "stay_den": ("1 - drop", "", "exposed"),
}


@query(
    "score_equations", "model:s exposed:i n:i events:i worst:i",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{m}' AS model, {g} AS exposed, count(*) AS n, sum({y}) AS events, 0 AS worst FROM rows {where} GROUP BY {g}"
        for m, (y, where, g) in _SCORES.items()
    ) + ")",
)
def score_equations(spark, sf):
    """Per model and group: rows, events, and the largest score of any term at the fit, in millionths of a residual per row."""
    table = written(weights.model_rows(rows(spark, sf).select(*st.MODEL_COLUMNS), F.col("int") == 1), "score-rows")
    models, beta = weights.fit_weight_models(table)
    coefs = weights.coefficients(spark, models, beta)
    scored, out = written(weights.with_probabilities(table, models, coefs), "scored"), None
    for m in (m for m in models if m.name in _SCORES):
        group = F.col("exposed") if "exposed" in m.by else F.lit(None).cast("int")
        gap = (F.col(m.outcome) - F.col(f"_p.{m.name}")) * F.col(m.freq)
        sums = [F.abs(F.sum(x * gap)) for x in (F.lit(1.0), *glm.term_columns(m.terms))]
        one = scored.where(F.col(m.freq) > 0).groupBy(group.alias("exposed")).agg(
            F.sum(m.freq).alias("n"), F.sum(F.col(m.outcome) * F.col(m.freq)).alias("events"), F.floor(F.greatest(*sums) * 1e6 / F.sum(m.freq)).alias("worst")
        ).withColumn("model", F.lit(m.name))
        out = one if out is None else out.unionByName(one)
    return out


_C3_MEASURES = summary.curve_measures(tuple(_C3), ratios=False)


_Y_MULTS = {**{k: v for k, v in _COPIES.items() if k != "copies"}, "people": "SELECT DISTINCT bene_id FROM years"}
# Curves on a common grid, differences, and deviations over the replicates.
_Y_SE = {
    "ytimes": "SELECT DISTINCT rep, time FROM curve UNION SELECT rep, 18 FROM reps",
    "yal": "SELECT g.*, " + ", ".join(
        f"coalesce((SELECT arg_max(c.risk_{c}, c.time) FROM curve c WHERE c.exposed = {s} AND c.rep = g.rep AND c.time <= g.time), 0.0) AS risk_{c}{s}"
        for c in _C3 for s in (0, 1)
    ) + " FROM ytimes g",
    "y_all": "SELECT *, " + ", ".join(f"risk_{c}1 - risk_{c}0 AS rd_{c}" for c in _C3) + " FROM yal",
    "ygrid": "SELECT r.rep, t.time FROM reps r, (SELECT DISTINCT time FROM y_all WHERE rep = 0) t",
    "yplaced": "SELECT g.rep, g.time, " + ", ".join(f"c.{m}" for m in _C3_MEASURES)
    + " FROM ygrid g ASOF JOIN y_all c ON c.rep = g.rep AND c.time <= g.time",
    "ydev": "SELECT time, " + ", ".join(f"stddev_samp({m}) AS se_{m}" for m in _C3_MEASURES) + " FROM yplaced GROUP BY time",
}


@query(
    "yearly_bootstrap_se", "time:x " + " ".join(f"{m}:x se_{m}:x" for m in _C3_MEASURES),
    "SELECT c.*, s.* EXCLUDE (time) FROM y_all c JOIN ydev s ON s.time = c.time WHERE c.rep = 0",
    more={
        **_Y_MULTS,
        "ycopies": "SELECT y.*, m.rep, m.mult FROM years y JOIN mults m ON m.bene_id = y.bene_id WHERE m.mult > 0",
        **q.curve_ctes("curve", "ycopies", "rep, exposed", "age - 1", "age", "mult", _C3),
        **_Y_SE,
    },
)
def yearly_bootstrap_se(spark, sf):
    """Nine yearly measures with bootstrap standard errors."""
    return st.yearly_bootstrap(yearly(spark, sf), REPS)


_SEEN = "CASE WHEN {0} = 1 THEN {1} ELSE 1 - {1} END"


@query(
    "yearly_weighted_saturated", "time:w " + " ".join(f"{m}:w se_{m}:w" for m in _C3_MEASURES) + " avg_wt:w min_wt:w max_wt:w",
    """SELECT c.*, s.* EXCLUDE (time), m.* EXCLUDE (time) FROM y_all c JOIN ydev s ON s.time = c.time
      LEFT JOIN ysumm m ON m.time = c.time WHERE c.rep = 0""",
    more={
        **_Y_MULTS,
        "yw0": """SELECT y.*, m.rep, m.mult, y.age = min(y.age) OVER (PARTITION BY y.bene_id, m.rep) AS is_first
          FROM years y JOIN mults m ON m.bene_id = y.bene_id WHERE m.mult > 0""",
        "yw1": f"SELECT *, {_mean('screen', 'rep, screen_1')} AS an, {_mean('screen', 'rep, enroll_period')} AS ad FROM yw0",
        "yw2": f"SELECT *, {_mean('exposed', 'rep')} AS em, {_mean('exposed', 'rep, sex')} AS ep FROM yw0 WHERE is_first",
        "yw3": f"""SELECT y.*, ({_SEEN.format('y.exposed', 'e.em')}) / ({_SEEN.format('y.exposed', 'e.ep')}) AS wt_exposure,
          ({_SEEN.format('screen', 'an')}) / ({_SEEN.format('screen', 'ad')}) AS wt_screen
          FROM yw1 y JOIN (SELECT bene_id, rep, em, ep FROM yw2) e ON e.bene_id = y.bene_id AND e.rep = y.rep""",
        "yw": """SELECT *, cum_screen * wt_exposure * product(wt_screen) OVER (PARTITION BY bene_id, rep ORDER BY age) AS wt_final FROM yw3""",
        **q.curve_ctes("curve", "yw", "rep, exposed", "age", "age + 1", "wt_final * mult", _C3),
        **_Y_SE,
        "ysumm": """SELECT age AS time, avg(wt_final) AS avg_wt, min(wt_final) AS min_wt, max(wt_final) AS max_wt
          FROM yw WHERE rep = 0 AND cum_screen = 1 GROUP BY age""",
    },
)
def yearly_weighted_saturated(spark, sf):
    """The weighted yearly analysis with nine standard errors; one category a model, so the fitted values are group means."""
    rows_ = yearly(spark, sf)
    given = {k: v for k, v in _one_each(spark, sf).items() if not k.startswith("stay")}
    lv = glm.levels(rows_, ["enroll_period"])
    return st.yearly_bootstrap(rows_, REPS, weighted=True, given={**given, "adherence_den": (glm.Category("enroll_period", lv["enroll_period"]),)})


# ---------------------------------------------------------------- descriptive tables


@query(
    "summary_stats", "min:x q1:x median:x mean:x q3:x max:x n:i",
    """SELECT min(age_start) AS min, quantile_cont(age_start, 0.25) AS q1, median(age_start) AS median, avg(age_start) AS mean,
      quantile_cont(age_start, 0.75) AS q3, max(age_start) AS max, count(*) AS n FROM base""",
)
def summary_stats(spark, sf):
    return summary.summary_stats(base(spark, sf), "age_start")


@query(
    "summary_stats_by_exposure", "exposed:i min:x q1:x median:x mean:x q3:x max:x n:i",
    """SELECT exposed, min(age_start) AS min, quantile_cont(age_start, 0.25) AS q1, median(age_start) AS median,
      avg(age_start) AS mean, quantile_cont(age_start, 0.75) AS q3, max(age_start) AS max, count(*) AS n FROM base GROUP BY exposed""",
)
def summary_stats_by_exposure(spark, sf):
    return summary.summary_stats(base(spark, sf), "age_start", ["exposed"])


_CATS = ("sex", "race", "enroll_period", "first_elig_state", "n_cond")


@query(
    "crosstab_oneway", "variable:s level:s n:i prop:x",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, count(*) AS n, count(*) / sum(count(*)) OVER () AS prop "
        f"FROM base WHERE {c} IS NOT NULL GROUP BY {c}" for c in (*_CATS, "exposed", "first_event")
    ),
)
def crosstab_oneway(spark, sf):
    return summary.crosstab_oneway(base(spark, sf), (*_CATS, "exposed", "first_event"))


def _colprop_sql(c: str) -> str:
    return f"""SELECT '{c}' AS variable, CAST(x AS VARCHAR) AS level, exposed, n, n / sum(n) OVER (PARTITION BY exposed) AS prop_col FROM (
      SELECT x, e.exposed, (SELECT count(*) FROM base b WHERE b.{c} = x AND b.exposed = e.exposed) AS n
      FROM (SELECT DISTINCT {c} AS x FROM base), (SELECT DISTINCT exposed FROM base) e)"""


@query("crosstab_colprop", "variable:s level:s exposed:i n:i prop_col:x", " UNION ALL ".join(map(_colprop_sql, _CATS)))
def crosstab_colprop(spark, sf):
    return summary.crosstab_colprop(base(spark, sf), _CATS, "exposed")


_FIRST_DEV = """SELECT exposed, floor(age_start) AS age_int, 1 - screen AS deviate FROM (
  SELECT *, coalesce(sum(1 - screen) OVER (PARTITION BY bene_id ORDER BY int ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past
  FROM rows) WHERE past = 0"""


@query(
    "crosstab_chisq", "exposed:i age_int:i deviate:i n:i prop_row:x prop_col:x prop_total:x chisq:x",
    """SELECT *, n / r AS prop_row, n / c AS prop_col, n / t AS prop_total, (n - r*c/t) * (n - r*c/t) / (r*c/t) AS chisq FROM (
      SELECT *, sum(n) OVER (PARTITION BY exposed, age_int) AS r, sum(n) OVER (PARTITION BY exposed, deviate) AS c,
        sum(n) OVER (PARTITION BY exposed) AS t FROM (
        SELECT a.exposed, a.age_int, d.deviate, count(v.exposed) AS n
        FROM (SELECT DISTINCT exposed, age_int FROM dev) a JOIN (SELECT DISTINCT exposed, deviate FROM dev) d ON a.exposed = d.exposed
        LEFT JOIN dev v ON v.exposed = a.exposed AND v.age_int = a.age_int AND v.deviate = d.deviate GROUP BY ALL))""",
    more={"dev": _FIRST_DEV},
)
def crosstab_chisq(spark, sf):
    return summary.crosstab_chisq(pr.through_first_deviation(rows(spark, sf)), "age_int", "deviate", ["exposed"])


@query(
    "followup_length", "tot_length:x med_length:x",
    f"SELECT sum(len) AS tot_length, median(len) AS med_length FROM (SELECT {q.div('baseline', 'end_date', 1)} AS len FROM base)",
)
def followup_length(spark, sf):
    return summary.followup_length(base(spark, sf))


# ---------------------------------------------------------------- reports


def _risk_table_sql(cause: str, places: int) -> str:
    def pct(n):
        return f"round({n} * 100, 1)"

    def txt(a, b, p):
        return f"concat('(', printf('%.{p}f', round({a}, {p})), ', ', printf('%.{p}f', round({b}, {p})), ')')"

    r1, r0, rd, rr = f"risk_{cause}1", f"risk_{cause}0", f"rd_{cause}", f"rr_{cause}"
    return f"""SELECT floor(time) AS age, {pct(r1)} AS exposed_risk, {txt(r1 + '_ll * 100', r1 + '_ul * 100', 1)} AS exposed_ci,
      {pct(r0)} AS unexposed_risk, {txt(r0 + '_ll * 100', r0 + '_ul * 100', 1)} AS unexposed_ci, {pct(rd)} AS rd,
      {txt(rd + '_ll * 100', rd + '_ul * 100', 1)} AS rd_ci, round({rr}, {places}) AS rr,
      {txt(rr + '_ll', rr + '_ul', places)} AS rr_ci FROM res WHERE floor(time) IN (55, 60, 65)
      QUALIFY row_number() OVER (PARTITION BY floor(time) ORDER BY time DESC) = 1"""


_TABLE_SPEC = "age:i exposed_risk:x exposed_ci:s unexposed_risk:x unexposed_ci:s rd:x rd_ci:s rr:x rr_ci:s"


@query("risk_table", _TABLE_SPEC, _risk_table_sql("primary", 2), more=_RESULT)
def risk_table(spark, sf):
    return report.risk_table(boot_result(spark, sf))


@query("risk_table_competing", _TABLE_SPEC, _risk_table_sql("competing", 1), more=_RESULT)
def risk_table_competing(spark, sf):
    return report.risk_table(boot_result(spark, sf), cause="competing", rr_places=1)


_TIDY_CI = f"""SELECT * FROM (SELECT exposed, time, 1 AS state, risk_primary AS estimate, lower_primary AS lower, upper_primary AS upper FROM cis
  UNION ALL SELECT exposed, time, 2, risk_competing, lower_competing, upper_competing FROM cis)"""
_CIS = {**_ROBUST, "cis": f"SELECT *, {_loglog_sql('primary')}, {_loglog_sql('competing')} FROM sds", "tidy": _TIDY_CI}


def _tidy_ci(spark, sf):
    return survival.tidy_curve(survival.robust_incidence(rows(spark, sf)), extra=("lower", "upper"))


for _name, _state in (("crude_table", 1), ("crude_table_competing", 2)):
    query(
        _name, "exposed:i age:i time:x state:i estimate:x lower:x upper:x",
        f"""SELECT *, floor(time) AS age FROM tidy WHERE state = {_state} AND floor(time) IN (55, 60, 65)
          QUALIFY row_number() OVER (PARTITION BY exposed, floor(time) ORDER BY time DESC) = 1""",
        more=_CIS,
    )(lambda spark, sf, state=_state: report.crude_table(_tidy_ci(spark, sf), state=state))


@query(
    "crude_series", "time:x arm:s outcome:s estimate:x lower:x upper:x",
    """SELECT *, CASE WHEN exposed = 0 THEN 'Without exposure' ELSE 'With exposure' END AS arm,
      CASE WHEN state = 1 THEN 'Primary' ELSE 'Death' END AS outcome FROM tidy""",
    more=_CIS,
)
def crude_series(spark, sf):
    return report.crude_series(_tidy_ci(spark, sf))


@query(
    "curve_series", "time:x arm:s outcome:s estimate:x lower:x upper:x",
    " UNION ALL ".join(
        f"""SELECT time, '{g}' AS arm, '{o}' AS outcome, risk_{c}{s} AS estimate,
          {f'CASE WHEN risk_{c}{s}_ll < 0 THEN 0 ELSE risk_{c}{s}_ll END' if c == 'primary' else f'risk_{c}{s}_ll'} AS lower,
          risk_{c}{s}_ul AS upper FROM res"""
        for s, g in ((0, "Without exposure"), (1, "With exposure")) for c, o in (("primary", "Primary"), ("competing", "Death"))
    ),
    more=_RESULT,
)
def curve_series(spark, sf):
    return report.curve_series(boot_result(spark, sf))


@query("result_roundtrip", "exposed:i time:x risk_primary:x risk_competing:x", "SELECT * FROM curve", more=_CRUDE)
def result_roundtrip(spark, sf):
    """A result written under its own path and read back with its schema."""
    df = survival.cumulative_incidence(rows(spark, sf), ["exposed"], origin=None)
    root = fresh_path(spark, "results")
    path = files.result_path(root, "main", EVERY, weight_kind="crude")
    files.write_result(df, path)
    return files.read_result(spark, path, df.schema)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crude cumulative incidence by exposure from the raw tables."""
    return REGISTRY["cif_crude"].run(spark, sf_dir)
