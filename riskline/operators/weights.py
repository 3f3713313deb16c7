"""Stabilised inverse-probability weights for exposure, adherence and drop-out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.operators.glm import Category, Logit, Numeric, Spline, fit_logits, levels, probabilities
from riskline.operators.quantiles import group_summary
from riskline.operators.replicates import Counts

# Covariates of the weight models.
BASELINE_COVARIATES = ("race", "sex", "first_elig_state", "enroll_period")
INTERVAL_COVARIATES = ("race", "sex", "first_elig_state", "n_cond", "n_cond_1", "enroll_period")


def _probability(event: Column, p: Column) -> Column:
    """Probability of the observed value of a 0/1 column."""
    return F.when(event == 1, p).otherwise(1 - p)


def weight_models(
    age: Spline | Category,
    lv: Mapping[str, tuple],
    omit: Sequence[str] = (),
    dropout: bool = True,
    by: tuple[str, ...] = ("rep", "exposed"),
    base_age: Spline | None = None,
    given: Mapping[str, tuple] | None = None,
) -> list[Logit]:
    """Exposure, adherence and drop-out models; ``omit`` leaves covariates out of all of them.

    Interval models are fitted per group in ``by``.  The drop-out model is on
    remaining under observation and also uses the current adherence flag.
    ``given`` replaces the terms of the models it names.
    """
    cat = lambda names: tuple(Category(c, lv[c]) for c in names if c not in omit)
    lags = (Numeric("screen_1"), Numeric("screen_2"))
    now = (Numeric("screen"),)
    full = cat(INTERVAL_COVARIATES)
    models = [
        Logit("exposure", "exposed", (base_age or age, *cat(BASELINE_COVARIATES)), freq="n_base", by=("rep",)),
        Logit("adherence_num", "screen", (age, *lags), by=by),
        Logit("adherence_den", "screen", (age, *lags, *full), by=by),
    ]
    if dropout:
        models += [
            Logit("stay_num", "stay", (age, *now, *lags), by=by),
            Logit("stay_den", "stay", (age, *now, *lags, *full), by=by),
        ]
    return [replace(m, terms=tuple(given[m.name])) if given and m.name in given else m for m in models]


def model_rows(df: DataFrame, first: Column, dropout: bool = True) -> DataFrame:
    """Rows with the outcomes and frequencies of the weight models; ``first`` marks the baseline row of a person.

    ``mult`` counts a row that often if there is such a column.
    """
    n = F.col("mult") if "mult" in df.columns else F.lit(1)
    df = df.withColumns({"freq": n, "n_base": F.when(first, n).otherwise(0)})
    return df.withColumn("stay", (F.col("drop") == 0).cast("int")) if dropout else df


def fit_weight_models(
    table: DataFrame,
    age: str = "age_start",
    omit: Sequence[str] = (),
    dropout: bool = True,
    age_as_category: bool = False,
    pooled: bool = False,
    given: Mapping[str, tuple] | None = None,
    counts: Counts | None = None,
) -> tuple[list[Logit], dict[tuple, np.ndarray]]:
    """Fit all models, and the marginal probability of exposure, on a written table of ``model_rows``.

    With ``counts`` all its replicates are fitted from the single rows.  The coefficients are keyed
    ``(name, *group)``.
    """
    lv = levels(table, [*(c for c in INTERVAL_COVARIATES if c not in omit), *([age] if age_as_category else [])])
    lo, hi = table.agg(F.min(age), F.max(age)).first()
    spline = Spline(age, float(lo or 0), float(hi or 0))
    term = Category(age, lv[age]) if age_as_category else spline
    by = ("rep",) if pooled else ("rep", "exposed")
    models = weight_models(term, lv, omit, dropout, by, spline, given)
    models.append(Logit("marginal", "exposed", (), freq="n_base", by=("rep",)))
    return models, fit_logits(table, models, counts=counts)


def coefficients(spark: SparkSession, models: Sequence[Logit], beta: Mapping[tuple, np.ndarray]) -> DataFrame:
    """One row for each stratum: ``beta_<model>`` and ``p_exposed``, the marginal probability of exposure."""
    rows = []
    for exposed in (0, 1):
        found = [beta.get((m.name, exposed) if "exposed" in m.by else (m.name,)) for m in models]
        p = float(1 / (1 + np.exp(-beta[("marginal",)][0]))) if ("marginal",) in beta else None
        rows.append((exposed, p, *[None if b is None else [float(x) for x in b] for b in found]))
    schema = T.StructType(
        [T.StructField("exposed", T.IntegerType()), T.StructField("p_exposed", T.DoubleType())]
        + [T.StructField(f"beta_{m.name}", T.ArrayType(T.DoubleType())) for m in models]
    )
    # Two rows of a few hundred numbers, whatever the data.
    return F.broadcast(spark.createDataFrame(rows, schema))


def with_probabilities(df: DataFrame, models: Sequence[Logit], coefs: DataFrame) -> DataFrame:
    """The rows of the strata of ``coefs`` with ``p_exposed`` and ``_p``, the fitted probability of each model."""
    found = {r["exposed"]: {m.name: r[f"beta_{m.name}"] for m in models} for r in coefs.collect()}
    return df.join(coefs.select("exposed", "p_exposed"), "exposed").withColumn("_p", probabilities(models, found))


def exposure_weight(p_marginal: Column, p_fitted: Column) -> Column:
    """Stabilised weight of the observed exposure."""
    seen = F.col("exposed")
    return _probability(seen, p_marginal) / _probability(seen, p_fitted)


def adherence_weight(p_num: Column, p_den: Column) -> Column:
    """Stabilised weight of the observed adherence flag."""
    seen = F.col("screen")
    return _probability(seen, p_num) / _probability(seen, p_den)


def dropout_weight(p_num: Column, p_den: Column) -> Column:
    """Stabilised weight of remaining under observation; zero on the drop-out row."""
    stay = (F.col("drop") == 0).cast("int")
    return F.when(stay == 1, p_num).otherwise(F.lit(0.0)) / _probability(stay, p_den)


def interval_weights(df: DataFrame, models: Sequence[Logit], coefs: DataFrame, first: Column, order: str = "int") -> DataFrame:
    """From the ``coefficients`` of one fit add ``wt_exposure`` (of the person's first row), ``wt_screen`` and ``wt_drop`` to each row."""
    p = {m.name: F.col(f"_p.{m.name}") for m in models}
    person = Window.partitionBy("bene_id", "rep").orderBy(order)
    at_first = F.when(first, exposure_weight(F.col("p_exposed"), p["exposure"]))
    out = with_probabilities(df, models, coefs).withColumns(
        {
            "_wt_first": at_first,
            "wt_screen": adherence_weight(p["adherence_num"], p["adherence_den"]),
            "wt_drop": dropout_weight(p["stay_num"], p["stay_den"]) if "stay_num" in p else F.lit(1.0),
        }
    )
    out = out.withColumn("wt_exposure", F.first("_wt_first").over(person.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_wt_first", "p_exposed", "_p")


def cumulative_weights(df: DataFrame, order: str = "int", key: Sequence[str] = ("bene_id", "rep")) -> DataFrame:
    """Running products and the final adherence (``wt_final``) and exposure-only weights."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns(
        {"cum_wt_screen": F.product("wt_screen").over(w), "cum_wt_drop": F.product("wt_drop").over(w)}
    ).withColumns(
        {
            "wt_final": F.col("cum_screen") * F.col("wt_exposure") * F.col("cum_wt_screen") * F.col("cum_wt_drop"),
            "wt_final_exposure": F.col("wt_exposure") * F.col("cum_wt_drop"),
        }
    )


def weight_summary(
    df: DataFrame, by: Sequence[str] = ("rep", "age_start"), weight: str = "wt_final", freq: Column | None = None
) -> DataFrame:
    """Count, mean, min, p5, p95 and max of the weight over adherent rows per group."""
    names = {"n": "n", "mean": "avg_wt", "min": "min_wt", "max": "max_wt"}
    return group_summary(df.where("cum_screen = 1"), by, weight, {"p5_wt": 0.05, "p95_wt": 0.95}, freq, names)


def mean_weight_summary(df: DataFrame, by: Sequence[str], weight: str = "wt_final", freq: Column | None = None) -> DataFrame:
    """Mean, min and max of the weight over adherent rows per group."""
    n = F.lit(1) if freq is None else freq
    return df.where("cum_screen = 1").groupBy(*by).agg(
        (F.sum(F.col(weight) * n) / F.sum(n)).alias("avg_wt"), F.min(weight).alias("min_wt"), F.max(weight).alias("max_wt")
    )


def truncate_weight(
    df: DataFrame, summary: DataFrame, by: Sequence[str] = ("rep", "age_start"), weight: str = "wt_final", cap: float = 100.0
) -> DataFrame:
    """Weights above ``cap`` replaced by the group's 95th percentile; NULL weights stay NULL."""
    known = summary.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("p95_wt").alias("_p95"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    cut = F.when(F.col(weight) > cap, F.col("_p95")).otherwise(F.col(weight))
    return df.join(known, same, "left").withColumn(weight, cut).select(*df.columns)
