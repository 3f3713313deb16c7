"""Result tables and figure-ready series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.functions.expressions import clip_lower, interval_text
from riskline.functions.sequence import last_per_key

# Labels of groups and outcomes in figures.
GROUP_LABELS = {0: "Without exposure", 1: "With exposure"}
OUTCOME_LABELS = {1: "Primary", 2: "Death"}


def _label(column: Column, labels: Mapping[int, str]) -> Column:
    expr = None
    for value, text in labels.items():
        expr = F.when(column == value, text) if expr is None else expr.when(column == value, text)
    return expr


def risk_table(res: DataFrame, ages: Sequence[int] = (55, 60, 65), cause: str = "primary", rr_places: int = 2) -> DataFrame:
    """Risks, difference and ratio with intervals at the last event time within each age."""
    rows = res.withColumn("age", F.floor("time").cast("int")).where(F.col("age").isin(list(ages)))
    last = last_per_key(rows, ["age"], ["time"])

    def percent(name: str) -> Column:
        return F.round(F.col(name) * 100, 1)

    def limits(name: str) -> Column:
        return interval_text(F.col(f"{name}_ll") * 100, F.col(f"{name}_ul") * 100, 1)

    r1, r0, rd, rr = f"risk_{cause}1", f"risk_{cause}0", f"rd_{cause}", f"rr_{cause}"
    return last.select(
        "age",
        percent(r1).alias("exposed_risk"),
        limits(r1).alias("exposed_ci"),
        percent(r0).alias("unexposed_risk"),
        limits(r0).alias("unexposed_ci"),
        percent(rd).alias("rd"),
        limits(rd).alias("rd_ci"),
        F.round(rr, rr_places).alias("rr"),
        interval_text(F.col(f"{rr}_ll"), F.col(f"{rr}_ul"), rr_places).alias("rr_ci"),
    )


def crude_table(tidy: DataFrame, ages: Sequence[int] = (55, 60, 65), state: int = 1) -> DataFrame:
    """Last row per age and group of one state of a tidy curve."""
    rows = tidy.where(F.col("state") == state).withColumn("age", F.floor("time").cast("int"))
    return last_per_key(rows.where(F.col("age").isin(list(ages))), ["exposed", "age"], ["time"])


def crude_series(tidy: DataFrame, states: Sequence[int] = (1, 2)) -> DataFrame:
    """Tidy crude curve with figure labels."""
    return tidy.where(F.col("state").isin(list(states))).withColumns(
        {"arm": _label(F.col("exposed"), GROUP_LABELS), "outcome": _label(F.col("state"), OUTCOME_LABELS)}
    )


def curve_series(
    res: DataFrame, causes: Mapping[str, int] = {"primary": 1, "competing": 2}, clip: Sequence[str] = ("primary",)
) -> DataFrame:
    """Step and ribbon series: one row per time, arm and outcome; lower limits clipped at zero."""
    entries = []
    for name, code in causes.items():
        for s in (0, 1):
            low = F.col(f"risk_{name}{s}_ll")
            entries.append(
                F.struct(
                    F.lit(GROUP_LABELS[s]).alias("arm"),
                    F.lit(OUTCOME_LABELS[code]).alias("outcome"),
                    F.col(f"risk_{name}{s}").alias("estimate"),
                    (clip_lower(low) if name in clip else low).alias("lower"),
                    F.col(f"risk_{name}{s}_ul").alias("upper"),
                )
            )
    return res.select("time", F.explode(F.array(*entries)).alias("_s")).select("time", "_s.*")
