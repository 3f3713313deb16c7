"""Competing-risk cumulative incidence by an event-time sweep.

Panel rows are reduced to sums per distinct time by a combining aggregate
before anything is ordered.  Ages are whole years plus a day fraction of a 365-
or 366-day year, so a curve has at most 731 distinct times per year of age and
the ordered windows never see people, however many there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.functions.expressions import ratio
from riskline.operators import exact
from riskline.operators.lineage import written

# Weights are summed as decimals: exact whatever their order, so what leaves a risk set is what entered it.
WEIGHT = "decimal(38,15)"

WHOLE = ("tinyint", "smallint", "int", "bigint")

# Default event codes.
CAUSES = {"primary": 1, "competing": 2}


def _ordered(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("time")


def _upto(by):
    return _ordered(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(by):
    return _ordered(by).rowsBetween(Window.unboundedPreceding, -1)


def risk_sets(
    df: DataFrame,
    by: Sequence[str],
    start: str = "age_start",
    stop: str = "age_end",
    event: str = "event",
    weight: Column | None = None,
    causes: Mapping[str, int] = CAUSES,
) -> DataFrame:
    """Weight at risk and event weight per cause at every distinct start or stop time.

    A row is at risk over ``(start, stop]``; rows that do not last carry no weight.  A
    weight counts to 15 decimals.
    """
    kind = "bigint" if weight is None or dict(df.select(weight.alias("w")).dtypes)["w"] in WHOLE else WEIGHT
    w = F.lit(1) if weight is None else weight
    # A product with zero would widen the type and cut decimals; a missing weight counts nothing.
    none = F.lit(0).cast(kind)
    rows = df.withColumn("_w", F.when((F.col(start) < F.col(stop)) & w.isNotNull(), w.cast(kind)).otherwise(none))
    enter = F.struct(
        F.col(start).cast("double").alias("time"), F.col("_w").alias("enter"), none.alias("leave"),
        *[none.alias(f"n_{c}") for c in causes],
    )
    leave = F.struct(
        F.col(stop).cast("double").alias("time"), none.alias("enter"), F.col("_w").alias("leave"),
        *[F.when(F.col(event) == code, F.col("_w")).otherwise(none).alias(f"n_{c}") for c, code in causes.items()],
    )
    points = rows.select(*by, F.explode(F.array(enter, leave)).alias("_p")).select(*by, "_p.*")
    sums = points.groupBy(*by, "time").agg(
        F.sum("enter").alias("enter"), F.sum("leave").alias("leave"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in causes],
    )
    entered = F.sum("enter").over(_before(by))
    left = F.sum("leave").over(_before(by))
    out = sums.withColumn("n_risk", F.coalesce((entered - left).cast(kind), none))
    if weight is None:
        return out
    return out.withColumns({c: F.col(c).cast("double") for c in ("enter", "leave", "n_risk", *[f"n_{c}" for c in causes])})


def _curve(sets: DataFrame, by: Sequence[str], causes: Mapping[str, int]) -> DataFrame:
    """All grid times with hazards, survival and cumulative incidence."""
    hazards = {
        f"h_{c}": F.coalesce(F.when(F.col(f"n_{c}") > 0, F.try_divide(F.col(f"n_{c}"), F.col("n_risk"))), F.lit(0.0))
        for c in causes
    }
    df = sets.withColumns(hazards)
    h = sum((F.col(f"h_{c}") for c in causes), F.lit(0.0))
    # All causes are held together, so that survival and incidences add up to one.
    df = df.withColumns({f"h_{c}": F.col(f"h_{c}") / F.greatest(h, F.lit(1.0)) for c in causes})
    # Where everybody at risk has an event nothing is left, whatever the shares' last digit says.
    last = sum((F.col(f"n_{c}") for c in causes), F.lit(0)) >= F.col("n_risk") * (1 - 1e-15)
    df = df.withColumn("h", F.when(last & (F.col("n_risk") > 0), 1.0).otherwise(F.least(h, F.lit(1.0)))).withColumn("surv", F.product(1 - F.col("h")).over(_upto(by)))
    df = df.withColumn("surv_before", F.lag("surv", 1, 1.0).over(_ordered(by)))
    return df.withColumns(
        {f"risk_{c}": F.sum(F.col("surv_before") * F.col(f"h_{c}")).over(_upto(by)) for c in causes}
    )


def with_origin(
    grid: DataFrame, by: Sequence[str], origin: float | None, keep: Column, columns: Sequence[str]
) -> DataFrame:
    """Rows of ``grid`` where ``keep`` holds, after a row without risk at ``origin`` per group.

    The origin row is emitted next to the group's first time, so the curve is
    computed once.
    """
    row = {c: F.col(c) for c in columns}
    empty = {
        c: F.lit(float(origin or 0.0)) if c == "time" else F.lit(1.0) if c == "surv"
        else F.lit(0.0) if c.startswith("risk_") else F.lit(None)
        for c in columns
    }
    types = dict(grid.dtypes)

    def as_struct(values: Mapping[str, Column]) -> Column:
        return F.struct(*[values[c].cast(types[c]).alias(c) for c in columns])

    is_first = F.row_number().over(_ordered(by)) == 1
    rows = [F.when(F.col("_keep"), as_struct(row))]
    if origin is not None:
        rows.insert(0, F.when(F.col("_first"), as_struct(empty)))
    out = grid.withColumns({"_keep": keep, "_first": is_first}).where("_keep or _first")
    return out.select(*by, F.explode(F.array_compact(F.array(*rows))).alias("_r")).select(*by, "_r.*")


def cumulative_incidence(
    df: DataFrame,
    by: Sequence[str],
    start: str = "age_start",
    stop: str = "age_end",
    event: str = "event",
    weight: Column | None = None,
    causes: Mapping[str, int] = CAUSES,
    origin: float | None = 50.0,
) -> DataFrame:
    """Weighted state probabilities at the event times of each group (late entry allowed).

    Columns: ``by``, ``time``, ``n_risk``, ``n_<cause>``, ``surv``, ``risk_<cause>``.
    """
    return steps(risk_sets(df, by, start, stop, event, weight, causes), by, causes, origin)


def steps(sets: DataFrame, by: Sequence[str], causes: Mapping[str, int] = CAUSES, origin: float | None = 50.0) -> DataFrame:
    """State probabilities at the event times of risk sets (``time``, ``n_risk``, ``n_<cause>``), which may hold other times too."""
    grid = _curve(sets, by, causes)
    had_event = sum((F.col(f"n_{c}") for c in causes), F.lit(0)) > 0
    columns = ["time", "n_risk", *[f"n_{c}" for c in causes], "surv", *[f"risk_{c}" for c in causes]]
    return with_origin(grid, by, origin, had_event, columns)


def curves_wide(
    curve: DataFrame, by: Sequence[str] = (), stratum: str = "exposed", causes: Mapping[str, int] = CAUSES
) -> DataFrame:
    """One row per time with a column per cause and stratum, NULL where a curve has no step."""
    return curve.groupBy(*by, "time").agg(
        *[
            F.max(F.when(F.col(stratum) == s, F.col(f"risk_{c}"))).alias(f"risk_{c}{s}")
            for s in (0, 1)
            for c in causes
        ]
    )


def align_curves(
    curve: DataFrame,
    by: Sequence[str] = (),
    stratum: str = "exposed",
    mode: str = "asof",
    causes: Mapping[str, int] = CAUSES,
) -> DataFrame:
    """Both strata on one time grid, each carried forward between its steps.

    ``asof`` and ``full`` use the times of both curves; ``exact_left`` uses those
    of stratum 0, so a step of stratum 1 at any other time is lost.
    """
    if mode not in ("asof", "full", "exact_left"):
        raise ValueError(f"unknown mode {mode!r}")
    wide = curves_wide(curve, by, stratum, causes)
    if mode == "exact_left":
        wide = wide.where(F.col(f"risk_{next(iter(causes))}0").isNotNull())
    columns = [f"risk_{c}{s}" for s in (0, 1) for c in causes]
    return wide.withColumns({c: F.last(c, ignorenulls=True).over(_upto(by)) for c in columns})


def contrast(wide: DataFrame, causes: Mapping[str, int] = CAUSES) -> DataFrame:
    """Risk difference and ratio of stratum 1 against stratum 0 per cause."""
    new = {}
    for c in causes:
        new[f"rd_{c}"] = F.col(f"risk_{c}1") - F.col(f"risk_{c}0")
        new[f"rr_{c}"] = ratio(F.col(f"risk_{c}1"), F.col(f"risk_{c}0"))
    return wide.withColumns(new)


def tidy_curve(
    curve: DataFrame, by: Sequence[str] = ("exposed",), causes: Mapping[str, int] = CAUSES, extra: Sequence[str] = ()
) -> DataFrame:
    """Long form: one row per time, group and event state, with bounds if present.

    ``extra`` names per-cause columns, e.g. ``lower`` for ``lower_primary``.
    """
    states = F.array(
        *[
            F.struct(
                F.lit(code).alias("state"),
                F.col(f"risk_{c}").alias("estimate"),
                *[F.col(f"{x}_{c}").alias(x) for x in extra],
            )
            for c, code in causes.items()
        ]
    )
    return curve.select(*by, "time", F.explode(states).alias("_s")).select(*by, "time", "_s.*")


def robust_incidence(
    df: DataFrame,
    by: Sequence[str] = ("exposed",),
    key: str = "bene_id",
    start: str = "age_start",
    stop: str = "age_end",
    event: str = "event",
    weight: Column | None = None,
    causes: Mapping[str, int] = CAUSES,
    z: float = 1.959963984540054,
) -> DataFrame:
    """Cumulative incidence with person-clustered standard errors and log-log limits.

    The influence of a person on cause k at time t is ``P(t) - F_k(t) Q(t)``, where
    P and Q change linearly in two curve functions while the person is at risk and
    stay constant otherwise.  The sums of squares and products over people are thus
    running sums over entries and exits at the distinct times, at every time at
    once, and cost one pass over the rows; they are exact, see ``operators.exact``.
    Rows without a weight take no part.
    """
    by = list(by)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.where((F.col(start) < F.col(stop)) & w.isNotNull() & ~F.isnan(w)).select(
        *by, key, F.col(start).cast("double").alias("_a"), F.col(stop).cast("double").alias("_b"),
        F.col(event).alias("_e"), w.alias("_w"),
    )
    rows = written(rows, "spans")
    grid = _curve(risk_sets(rows, by, "_a", "_b", "_e", F.col("_w"), causes), by, causes)

    # Slopes of Q and P per unit weight at risk, and the jumps of an event row.
    open_ = F.col("h") < 1
    at_risk = F.when(F.col("n_risk") > 0, F.col("n_risk"))
    unit = F.coalesce(F.when(open_, 1 / (at_risk * (1 - F.col("h")))), F.lit(0.0))
    scale = F.coalesce(F.col("surv_before") / at_risk, F.lit(0.0))
    grid = grid.withColumns({"_unit": unit, "_scale": scale, "_dq": -unit * F.col("h")})
    grid = grid.withColumns(
        {f"_dp_{c}": F.col("_dq") * F.col(f"risk_{c}") - F.col("_scale") * F.col(f"h_{c}") for c in causes}
    )
    parts = ["q", *[f"p_{c}" for c in causes]]
    grid = grid.withColumns({f"g_{p}": F.sum(f"_d{p}").over(_upto(by)) for p in parts})

    # One struct per time is looked up at the start and at the stop of each row.
    grid = written(grid, "curve")
    lookup = grid.select(
        *by, "time", F.struct(*[f"g_{p}" for p in parts], "_unit", "_scale", *[f"risk_{c}" for c in causes]).alias("_at")
    )
    rows = rows.join(lookup.withColumnsRenamed({"time": "_a", "_at": "_in"}), [*by, "_a"])
    rows = rows.join(lookup.withColumnsRenamed({"time": "_b", "_at": "_out"}), [*by, "_b"])
    had = F.col("_e").isin(*causes.values()).cast("double")
    gain = {"q": F.col("_w") * (F.col("_out.g_q") - F.col("_in.g_q") + had * F.col("_out._unit"))}
    for c, code in causes.items():
        own = (F.col("_e") == code).cast("double")
        jump = had * F.col("_out._unit") * F.col(f"_out.risk_{c}") + own * F.col("_out._scale")
        gain[f"p_{c}"] = F.col("_w") * (F.col(f"_out.g_p_{c}") - F.col(f"_in.g_p_{c}") + jump)
    rows = rows.withColumns({f"d_{p}": e for p, e in gain.items()})
    person = Window.partitionBy(*by, key).orderBy("_a")
    earlier = person.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"c_{p}": F.coalesce(F.sum(f"d_{p}").over(earlier), F.lit(0.0)) for p in parts})
    rows = rows.withColumn("_next", F.lead("_a").over(person))

    # While at risk a part equals o + w*g(t); after the row it is the constant e.
    spans = rows.select(
        *by, F.col("_a").alias("start"), F.col("_b").alias("stop"), F.col("_next").alias("next"), F.col("_w").alias("w"),
        *[(F.col(f"c_{p}") - F.col("_w") * F.col(f"_in.g_{p}")).alias(f"o_{p}") for p in parts],
        *[(F.col(f"c_{p}") + F.col(f"d_{p}")).alias(f"e_{p}") for p in parts],
    )
    changes = exact.moments(written(spans, "influence"), by, parts)
    at = grid.select(*by, "time", "n_risk", "surv", *[f"n_{c}" for c in causes], *[f"g_{p}" for p in parts], *[F.col(f"risk_{c}").alias(f"risk_p_{c}") for c in causes])
    joined = exact.variances(at, changes, by, parts)
    joined = joined.withColumns({f"risk_{c}": F.col(f"risk_p_{c}") for c in causes} | {f"se_{c}": F.sqrt(f"var_p_{c}") for c in causes})
    bounds = {}
    for c in causes:
        risk = F.when((F.col(f"risk_{c}") > 0) & (F.col(f"risk_{c}") < 1), F.col(f"risk_{c}"))
        step = F.lit(z) * F.col(f"se_{c}") / (risk * F.log(risk))
        bounds[f"lower_{c}"] = F.exp(-F.exp(F.log(-F.log(risk)) - step))
        bounds[f"upper_{c}"] = F.exp(-F.exp(F.log(-F.log(risk)) + step))
    kept = [f"{n}_{c}" for c in causes for n in ("risk", "se", "lower", "upper")]
    had_event = sum((F.col(f"n_{c}") for c in causes), F.lit(0)) > 0
    return joined.withColumns(bounds).where(had_event).select(*by, "time", "n_risk", "surv", *kept)
