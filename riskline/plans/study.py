"""Study presets and the end-to-end plans built from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.functions.expressions import ENROLL_PERIODS
from riskline.operators import bootstrap, sampling, summary, survival, weights
from riskline.operators import events as ev
from riskline.operators.bootstrap import Design, Weights
from riskline.operators.protocol import apply_protocol
from riskline.operators.cohort import build_cohort
from riskline.operators.lineage import written
from riskline.operators.panel import build_panel
from riskline.operators.replicates import Counts

# End of follow-up and sampling fractions of the main study.
MAIN_CUTOFF = date(2015, 9, 30)
FRACTIONS = {1: 1.0, 0: 0.25}


@dataclass(frozen=True)
class Study:
    """Parameters of one study variant."""

    name: str = "main"
    cutoff: date = MAIN_CUTOFF
    refractory_years: float = 1.0
    include_types: tuple[int, ...] | None = None
    exclude_types: tuple[int, ...] | None = (3,)
    window_from: date | None = None
    wash_in: int = 6
    min_age: int = 50
    age_cap: int = 65
    months: int = 3
    preserve_boundary_event: bool = False
    periods: tuple[tuple[int, int], ...] = ENROLL_PERIODS


# Columns of the protocol rows that the weighted analysis reads.
MODEL_COLUMNS = (
    "bene_id", "int", "drop", "exposed", "age_start", "age_end", "event", "screen", "screen_1", "screen_2",
    "cum_screen", *weights.INTERVAL_COVARIATES,
)

MAIN = Study()
# The sensitivity variants differ from the main study in one parameter.
PRESETS = {
    "main": MAIN,
    "post2010": replace(MAIN, name="post2010", window_from=date(2010, 1, 1)),
    "related6mo": replace(MAIN, name="related6mo", refractory_years=0.5),
    "colonoscopy": replace(MAIN, name="colonoscopy", include_types=(1,), exclude_types=None),
}


def study_cohort(study: Study, subjects: DataFrame) -> DataFrame:
    return build_cohort(subjects, study.cutoff, study.wash_in, study.min_age, study.window_from, study.months)


def study_procedures(study: Study, procedures: DataFrame) -> DataFrame:
    return ev.procedure_filter(procedures, study.include_types, study.exclude_types)


def study_panel(study: Study, subjects: DataFrame, procedures: DataFrame) -> DataFrame:
    """Person-interval panel of a study from the raw tables."""
    return build_panel(
        study_cohort(study, subjects),
        study_procedures(study, procedures),
        study.cutoff,
        study.refractory_years,
        study.months,
        study.age_cap,
        study.preserve_boundary_event,
    )


def sampled_panel(panel: DataFrame, fractions=None, seed: int = 123) -> DataFrame:
    """All exposed and a fraction of unexposed people, with the sampling weight ``wt_s``."""
    fractions = FRACTIONS if fractions is None else fractions
    kept = sampling.sample_persons(panel, fractions, seed=seed)
    return kept.withColumn("wt_s", sampling.sampling_weight(fractions))


def stratum_panel(panel: DataFrame, column: str, value) -> DataFrame:
    """One race or sex stratum; leave ``column`` out of the models with ``omit``."""
    return panel.where(F.col(column) == value)


def model_table(rows: DataFrame, reps: int, seed: int = 1, method: str = "poisson") -> tuple[DataFrame, Counts]:
    """The rows of the weight models, written once, with what their tasks draw the replicates from."""
    drawn, counts = sampling.with_draws(rows.select(*MODEL_COLUMNS), reps, seed, method)
    return written(weights.model_rows(drawn, F.col("int") == 1), "model-rows"), counts


def _scored(table: DataFrame, models, beta, first: Column, order: str = "int") -> DataFrame:
    """Interval and final weights of the original rows from one fit, as replicate 0."""
    once = table.withColumns({"rep": F.lit(0), "mult": F.lit(1)})
    coefs = weights.coefficients(table.sparkSession, models, beta)
    return weights.cumulative_weights(weights.interval_weights(once, models, coefs, first, order), order)


def interval_weights(rows: DataFrame, omit: Sequence[str] = (), given=None) -> DataFrame:
    """Interval and final weights; ``rows`` come from ``apply_protocol``.

    ``given`` maps names of weight models to other terms for them.  The rows are written once, so
    neither the fits nor the scoring repeat the panel build.
    """
    table, _ = model_table(rows, 0)
    models, beta = weights.fit_weight_models(table, omit=omit, given=given)
    return _scored(table, models, beta, F.col("int") == 1)


def replicate_curves(
    table: DataFrame, counts: Counts, design: Design, models=(), beta=None, origin: float = 50.0
) -> DataFrame:
    """Curves of every replicate, stratum by stratum, from single rows; see ``operators.bootstrap``."""
    by = ["rep", design.stratum]
    sums = bootstrap.replicate_sums(table, counts, design, Weights(tuple(models), beta or {}))
    sums = written(sums, "sums")
    return survival.steps(bootstrap.at_risk(sums, by, design.causes), by, design.causes, origin)


def weighted_analysis(
    panel: DataFrame,
    every_years: float = 10,
    weight_kind: str = "adherence",
    reps: int = 0,
    omit: Sequence[str] = (),
    fractions=None,
    seed: int = 123,
    method: str = "poisson",
    mode: str = "asof",
    interval_mode: str = "asof",
    periods: Sequence[tuple[int, int]] = ENROLL_PERIODS,
    tolerance: float = 0.25,
    given=None,
    cap: float = 100.0,
) -> DataFrame:
    """Sampling, protocol, weights, curves and bootstrap intervals in one plan.

    All replicates are fitted and summed from the single rows.  The weight summary belongs to
    replicate 0, whose weights are the only ones that become rows.
    """
    rows = apply_protocol(sampled_panel(panel, fractions, seed), every_years, tolerance, periods)
    if weight_kind == "crude":
        return survival.tidy_curve(survival.robust_incidence(rows), extra=("se", "lower", "upper"))
    design = Design(weight_kind, survival.CAUSES, cap=cap if weight_kind == "adherence" else None)
    table, counts = model_table(rows, reps, seed, method)
    models, beta = weights.fit_weight_models(table, omit=omit, given=given, counts=counts)
    curve = replicate_curves(table, counts, design, models, beta)
    curves = written(survival.contrast(survival.align_curves(curve, ["rep"], mode=mode)), "curves")
    result = summary.summarise_bootstrap(curves, summary.curve_measures(), reps, interval_mode)
    if weight_kind == "adherence":
        weighted = _scored(table, models, {k: b[0] for k, b in beta.items()}, F.col("int") == 1)
        summ = weights.weight_summary(weighted, ["age_start"])
        result = result.join(summ.withColumnRenamed("age_start", "time"), "time", "left")
    return result


# Event codes of the yearly analysis.
YEARLY_CAUSES = {"primary": 1, "other": 2, "competing": 3}


def _yearly_table(rows: DataFrame, reps: int, seed: int, method: str) -> tuple[DataFrame, Counts, Column]:
    first_age = F.min("age").over(Window.partitionBy("bene_id"))
    drawn, counts = sampling.with_draws(rows.withColumn("first_age", first_age), reps, seed, method)
    first = F.col("age") == F.col("first_age")
    return written(weights.model_rows(drawn, first, dropout=False), "yearly-rows"), counts, first


def yearly_weights(rows: DataFrame, given=None) -> DataFrame:
    """Pooled weights of the yearly panel, age as a category in the adherence model, no drop-out model."""
    table, _, first = _yearly_table(rows, 0, 1, "poisson")
    models, beta = weights.fit_weight_models(table, "age", dropout=False, age_as_category=True, pooled=True, given=given)
    return _scored(table, models, beta, first, "age")


def yearly_bootstrap(
    rows: DataFrame, reps: int, weighted: bool = False, seed: int = 1, method: str = "poisson", given=None, origin: float = 18.0
) -> DataFrame:
    """Yearly risks and differences over three causes with bootstrap standard errors of all nine.

    Rows cover ``(age - 1, age]``, or ``(age, age + 1]`` for the weighted form, which also has
    the weight summary of replicate 0.
    """
    table, counts, first = _yearly_table(rows, reps, seed, method)
    shift = 1 if weighted else 0
    table = table.withColumns({"_from": (F.col("age") - 1 + shift).cast("double"), "_to": (F.col("age") + shift).cast("double")})
    models, beta = (), {}
    if weighted:
        models, beta = weights.fit_weight_models(
            table, "age", dropout=False, age_as_category=True, pooled=True, given=given, counts=counts
        )
    design = Design("adherence" if weighted else "count", YEARLY_CAUSES, "_from", "_to", order="age")
    curve = replicate_curves(table, counts, design, models, beta, origin)
    curves = written(yearly_contrasts(curve), "yearly-curves")
    result = summary.summarise_bootstrap(curves, summary.curve_measures(tuple(YEARLY_CAUSES), ratios=False), reps, kind="se")
    if weighted:
        scored = _scored(table, models, {k: b[0] for k, b in beta.items()}, first, "age")
        summ = weights.mean_weight_summary(scored, ["age"])
        result = result.join(summ.withColumnRenamed("age", "time"), "time", "left")
    return result


def yearly_contrasts(curve: DataFrame) -> DataFrame:
    """Three-cause curves per replicate on one grid, with risk differences."""
    wide = survival.align_curves(curve, ["rep"], mode="full", causes=YEARLY_CAUSES)
    return survival.contrast(wide, YEARLY_CAUSES).drop(*[f"rr_{c}" for c in YEARLY_CAUSES])


def yearly_curves(rows: DataFrame, weighted: bool = False, origin: float = 18.0) -> DataFrame:
    """Aligned three-cause curves of single rows (``rep``, ``mult``) with risk differences.

    Rows cover ``(age - 1, age]``, or ``(age, age + 1]`` for the weighted form.
    """
    shift = 1 if weighted else 0
    spans = rows.withColumns({"_from": F.col("age") - 1 + shift, "_to": F.col("age") + shift})
    w = F.col("wt_final") * F.col("mult") if weighted else F.col("mult")
    curve = survival.cumulative_incidence(
        spans, ["rep", "exposed"], "_from", "_to", "event", w, YEARLY_CAUSES, origin
    )
    res = yearly_contrasts(curve)
    if "wt_final" in rows.columns:
        summ = weights.mean_weight_summary(rows, ["rep", "age"], freq=F.col("mult"))
        res = res.join(summ.withColumnRenamed("age", "time"), ["rep", "time"], "left")
    return res
