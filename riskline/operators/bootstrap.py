"""Weighted curves of all bootstrap replicates from single rows.

A task takes the rows of whole people in order, draws the multiplicities of its people
(rows x replicates), evaluates the weight models for all replicates by one matrix product
each, multiplies them up along each person and adds the weights into sums per replicate,
stratum and event time.  What leaves the tasks is those sums; no stage holds a row for
each row and replicate.

Curves step at event times only, so a span is added where its first event time stands and
taken off behind its last one.  The event times are worked on in blocks of bounded size, a
pass over the rows for each; where ages are calendar fractions, one block holds them all.

Weights beyond ``cap`` give way to the 95th percentile of the weights of their replicate and time of
entry.  Only those weights leave the tasks as rows of their own, and only the groups they lie in
are ranked, in a further pass.

Sums are exact: weights count to 15 decimals, as two integers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskline.operators.glm import ETA_BOUND, Logit, _design, coded, pieces, ship
from riskline.operators.lineage import written
from riskline.operators.quantiles import exact_quantiles
from riskline.operators.replicates import Counts, chunks

#: Sums (event times x replicates) that a task holds for each stratum and cause.
GRID = 1_000_000
#: Parts of one in a weight, and rows whose parts can be added up before they are carried over.
UNIT, SAFE = 10**15, 8_000


@dataclass(frozen=True)
class Design:
    """The columns that curves are made of.

    ``weight`` is ``adherence`` (rows with ``cum_screen`` 1, all models), ``exposure`` (exposure
    and drop-out models) or ``count`` (the multiplicity alone).  ``start`` and ``stop``
    bound a row's span, ``order`` its place in the person's rows.
    """

    weight: str = "count"
    causes: Mapping[str, int] = field(default_factory=dict)
    start: str = "age_start"
    stop: str = "age_end"
    event: str = "event"
    order: str = "int"
    stratum: str = "exposed"
    key: str = "bene_id"
    cap: float | None = None

    def __post_init__(self):
        if self.weight not in ("adherence", "exposure", "count"):
            raise ValueError(f"unknown weight kind {self.weight!r}")

    @property
    def columns(self) -> list[str]:
        own = [self.start, self.stop, self.event, self.stratum]
        return own if self.weight == "count" else [*own, self.key, self.order, "n_base", "cum_screen"]


@dataclass(frozen=True)
class Weights:
    """Fitted weight models: ``beta`` has replicates x terms by (model, *group)."""

    models: tuple[Logit, ...] = ()
    beta: Mapping[tuple, np.ndarray] = field(default_factory=dict)

    def fitted(self, rows: pd.DataFrame, size: int) -> dict[str, np.ndarray]:
        """Probabilities by model, rows x replicates; NaN where a term is missing or nothing was fitted."""
        blocks: dict = {}
        out = {}
        for m in self.models:
            x, p = _design(rows, m.terms, blocks), np.full((len(rows), size), np.nan)
            groups = [c for c in m.by if c != "rep"]
            for group, at in rows.groupby(groups, sort=False).indices.items() if groups else [((), slice(None))]:
                beta = self.beta.get((m.name, *np.atleast_1d(group).astype(int).tolist()))
                if beta is not None:
                    p[at] = 1.0 / (1.0 + np.exp(-np.clip(x[at] @ beta.T, -ETA_BOUND, ETA_BOUND)))
            out[m.name] = p
        return out


def _observed(seen: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where(seen[:, None] == 1, p, 1.0 - p)


def _running(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products along each person from its first row on; missing factors are passed over."""
    seen, out = ~np.isnan(values), np.where(np.isnan(values), 1.0, values)
    sizes = np.diff(np.r_[starts, len(values)])
    for k in range(1, int(sizes.max(initial=0))):
        at = starts[sizes > k] + k
        out[at] *= out[at - 1]
        seen[at] |= seen[at - 1]
    return np.where(seen, out, np.nan)


def row_weights(rows: pd.DataFrame, size: int, fit: Weights, design: Design) -> np.ndarray:
    """Final weights of the rows of whole people in order, rows x replicates, without multiplicities."""
    ids = rows[design.key].to_numpy()
    if not len(rows):
        return np.zeros((0, size))
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    p = fit.fitted(rows, size)
    stratum = rows[design.stratum].to_numpy(float)
    exposed = _observed(stratum, p["marginal"]) / _observed(stratum, p["exposure"])
    first = np.where((rows["n_base"].to_numpy(float) > 0)[:, None], exposed, np.nan)[starts]
    out = np.repeat(first, np.diff(np.r_[starts, len(rows)]), axis=0)
    if "stay_num" in p:
        stay = rows["stay"].to_numpy(float)
        out = out * _running(np.where(stay[:, None] == 1, p["stay_num"], 0.0) / _observed(stay, p["stay_den"]), starts)
    if design.weight == "adherence":
        screen = rows["screen"].to_numpy(float)
        out = out * _running(_observed(screen, p["adherence_num"]) / _observed(screen, p["adherence_den"]), starts)
        out = out * rows["cum_screen"].to_numpy(float)[:, None]
    return out


def _places(rows: pd.DataFrame, times: np.ndarray, design: Design) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First event time of each span, first one behind it, and that of its event (or their number)."""
    start, stop = rows[design.start].to_numpy(float), rows[design.stop].to_numpy(float)
    at = np.searchsorted(times, stop)
    known = (at < len(times)) & (times[np.minimum(at, len(times) - 1)] == stop)
    return np.searchsorted(times, start, side="right"), np.searchsorted(times, stop, side="right"), np.where(known, at, len(times))


class _Grid:
    """Sums per stratum, event time and replicate: weight that comes under risk less what leaves, and events by cause.

    What belongs to the first of ``times``, or to those before, has been counted in another block.
    """

    def __init__(self, times: np.ndarray, size: int, design: Design):
        self.times, self.size, self.design = times, size, design
        self.sums: dict[int, np.ndarray] = {}
        self.seen: dict[int, np.ndarray] = {}

    def add(self, rows: pd.DataFrame, weight: np.ndarray) -> None:
        """Adds rows x replicates ``weight``; missing and infinite ones count nothing."""
        for i in range(0, len(rows), SAFE):
            self._add(rows.iloc[i : i + SAFE], weight[i : i + SAFE])

    def _add(self, rows: pd.DataFrame, weight: np.ndarray) -> None:
        weight = np.where(np.isfinite(weight), weight, 0.0)
        whole = np.floor(weight)
        limbs = whole.astype(np.int64), np.rint((weight - whole) * UNIT).astype(np.int64)
        enter, leave, event = _places(rows, self.times, self.design)
        code, stratum = rows[self.design.event].to_numpy(float), rows[self.design.stratum].to_numpy(float)
        for s in np.unique(stratum[~np.isnan(stratum)]).astype(int).tolist():
            if s not in self.sums:
                self.sums[s] = np.zeros((1 + len(self.design.causes), 2, len(self.times) + 1, self.size), np.int64)
                self.seen[s] = np.zeros(self.size, bool)
            sums, own = self.sums[s], np.flatnonzero(stratum == s)
            self.seen[s] |= weight[own].any(axis=0)
            for k, limb in enumerate(limbs):
                _scatter(sums[0, k], enter[own], limb[own])
                _scatter(sums[0, k], leave[own], -limb[own])
                for c, value in enumerate(self.design.causes.values(), start=1):
                    had = own[code[own] == value]
                    _scatter(sums[c, k], event[had], limb[had])
            carry = sums[:, 1] // UNIT
            sums[:, 0] += carry
            sums[:, 1] -= carry * UNIT

    def rows(self) -> Iterator[dict[str, np.ndarray]]:
        """The sums that are not zero, and the first ones of every replicate that has weight."""
        for s, sums in self.sums.items():
            kept = sums[:, :, : len(self.times)].any(axis=(0, 1))
            kept[0], kept[1] = False, kept[1] | self.seen[s]
            at, rep = np.nonzero(kept)
            out = {"rep": rep, "stratum": np.full(len(rep), s), "time": self.times[at]}
            for name, pair in zip(("net", *self.design.causes), sums, strict=True):
                out |= {f"{name}_{k}": limb[at, rep] for k, limb in enumerate(pair)}
            yield out


def _scatter(sums: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds the rows of ``values`` to the rows ``at`` of ``sums``."""
    if len(at):
        order = np.argsort(at, kind="stable")
        firsts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
        sums[at[order][firsts]] += np.add.reduceat(values[order], firsts, axis=0)


def _schema(design: Design) -> T.StructType:
    ints, longs = ["rep", "stratum", "event", "mult"], [f"{n}_{k}" for n in ("net", *design.causes) for k in (0, 1)]
    return T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ints]
        + [T.StructField(n, T.DoubleType()) for n in ("time", "stop")]
        + [T.StructField(n, T.LongType()) for n in longs]
    )


def _batches(columns: Mapping[str, np.ndarray], schema: T.StructType, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the columns of ``schema``; those not given are NULL."""
    kinds, n = to_arrow_schema(schema), len(next(iter(columns.values())))
    for i in range(0, n, most):
        size = min(most, n - i)
        made = [
            pa.array(columns[f.name][i : i + most], from_pandas=True).cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds
        ]
        yield pa.RecordBatch.from_arrays(made, schema=kinds)


def event_blocks(rows: DataFrame, design: Design, size: int) -> Iterator[np.ndarray]:
    """The distinct event times in order, at most GRID / ``size`` at a time, each block behind the last time of the one before."""
    had = F.col(design.event).isin(*design.causes.values()) & (F.col(design.start) < F.col(design.stop))
    times = written(rows.where(had).select(F.col(design.stop).cast("double").alias("time")).distinct(), "event-times")
    most, last = max(1, GRID // size), None
    while block := [r["time"] for r in times.where(F.lit(last is None) | (F.col("time") > last)).orderBy("time").limit(most).collect()]:
        yield np.array([float("-inf") if last is None else last, *block])
        last = block[-1]
        if len(block) < most:
            return


def _of_people(rows: DataFrame, design: Design, fit: Weights, counts: Counts, tasks: int, more: Sequence[str] = ()) -> DataFrame:
    """The columns the tasks read, whole people in order in one of ``tasks`` partitions; as they stand if only counts are summed."""
    kept = coded(rows, fit.models, [*design.columns, *counts.columns, *more])
    if design.weight == "count":
        return kept
    return kept.repartition(tasks, design.key).sortWithinPartitions(design.key, design.order)


def _weighted(rows: pd.DataFrame, mult: np.ndarray, fit: Weights, design: Design, size: int) -> np.ndarray:
    if design.weight == "count":
        return np.ones(mult.shape)
    return row_weights(rows, size, fit, design)


def replicate_sums(rows: DataFrame, counts: Counts, design: Design, fit: Weights = Weights()) -> DataFrame:
    """(rep, stratum, time) with ``net``, the change of the weight at risk, and ``n_<cause>``, at the event times.

    ``rows`` should be a written table with the columns of ``counts``.
    """
    _ship()
    size, schema = counts.size, _schema(design)
    people = _of_people(rows, design, fit, counts, pieces(rows))
    key = None if design.weight == "count" else design.key
    made: list[DataFrame] = []
    beyond: DataFrame | None = None
    for block, times in enumerate(event_blocks(rows, design, size)):
        cap = design.cap if block == 0 else None

        def add(batches: Iterator[pa.RecordBatch], times: np.ndarray = times, cap: float | None = cap) -> Iterator[pa.RecordBatch]:
            grid = _Grid(times, size, design)
            for part in chunks(batches, size, key):
                mult = counts.matrix(part)
                weight = _weighted(part, mult, fit, design, size)
                spans = (part[design.start] < part[design.stop]).to_numpy()
                if design.cap is not None:
                    over = (weight > design.cap) & (mult > 0) & spans[:, None]
                    if cap is not None and over.any():
                        at, rep = np.nonzero(over)
                        some = part.iloc[at]
                        yield from _batches(
                            {
                                "rep": rep, "mult": mult[at, rep], "stratum": some[design.stratum].to_numpy(), "event": some[design.event].to_numpy(),
                                "time": some[design.start].to_numpy(float), "stop": some[design.stop].to_numpy(float),
                            },
                            schema,
                        )
                    weight = np.where(over, 0.0, weight)
                grid.add(part[spans], (weight * mult)[spans])
            for columns in grid.rows():
                yield from _batches(columns, schema)

        one = written(people.mapInArrow(add, schema), "sums")
        if cap is not None:
            beyond = one.where("mult IS NOT NULL")
        made.append(one.where("mult IS NULL"))
        if beyond is not None and (block or beyond.limit(1).count()):
            beyond = written(_truncated(rows, beyond, counts, design, fit), "truncated") if block == 0 else beyond
            made.append(_binned(beyond, times, size, design, schema))
        else:
            beyond = None
    if not made:
        made.append(rows.sparkSession.createDataFrame([], schema))
    whole = made[0]
    for one in made[1:]:
        whole = whole.unionByName(one)
    sums = [_decimal(n).alias("net" if n == "net" else f"n_{n}") for n in ("net", *design.causes)]
    return whole.groupBy("rep", F.col("stratum").alias(design.stratum), "time").agg(*sums)


def _decimal(name: str) -> Column:
    """The exact sum of a pair of integers, as a decimal; the types in between keep all digits."""
    high, low = (F.sum(F.col(f"{name}_{k}").cast("decimal(20,0)")) for k in (0, 1))
    part = low.cast("decimal(22,0)") * F.lit(Decimal(1) / UNIT).cast("decimal(15,15)")
    return (high.cast("decimal(20,0)") + part.cast("decimal(36,15)")).cast("decimal(38,15)")


def _truncated(rows: DataFrame, beyond: DataFrame, counts: Counts, design: Design, fit: Weights) -> DataFrame:
    """``beyond`` with the 95th percentile of the weights of their replicate and time of entry, as ``weight``."""
    beyond = written(beyond, "beyond")
    hot = beyond.select("rep", F.col("time").alias("_at")).distinct()
    # One row a time, with the replicates that need its percentile: never more than there are replicates.
    hot = written(hot.groupBy("_at").agg(F.collect_list("rep").alias("_reps")), "hot")
    marked = rows.join(hot, F.col(design.start) == F.col("_at"), "left").drop("_at")
    size, kind = counts.size, T._parse_datatype_string("rep int, time double, w double, m int")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, size, design.key):
            mult, weight = counts.matrix(part), row_weights(part, size, fit, design)
            wanted = np.zeros(mult.shape, bool)
            for i, reps in enumerate(part["_reps"]):
                if reps is not None:
                    wanted[i, np.asarray(reps, int)] = True
            at, rep = np.nonzero(wanted & (mult > 0) & (part["cum_screen"].to_numpy(float) == 1)[:, None])
            if len(at):
                time = part[design.start].to_numpy(float)[at]
                yield from _batches({"rep": rep, "time": time, "w": weight[at, rep], "m": mult[at, rep]}, kind)

    ranked = _of_people(marked, design, fit, counts, pieces(rows), ["_reps"]).mapInArrow(values, kind)
    cut = exact_quantiles(written(ranked, "ranked"), ["rep", "time"], "w", [0.95], ["weight"], F.col("m"))
    return beyond.join(cut, ["rep", "time"])


def _binned(beyond: DataFrame, times: np.ndarray, size: int, design: Design, schema: T.StructType) -> DataFrame:
    """The sums of single weighted rows (rep, stratum, time, stop, event, mult, weight)."""
    own = Design(causes=design.causes, start="time", stop="stop", event="event", stratum="stratum")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = _Grid(times, size, own)
        for part in chunks(batches, size):
            weight = np.zeros((len(part), size))
            weight[np.arange(len(part)), part["rep"]] = part["weight"].to_numpy(float) * part["mult"].to_numpy(float)
            grid.add(part, weight)
        for columns in grid.rows():
            yield from _batches(columns, schema)

    return beyond.mapInArrow(add, schema)


def at_risk(sums: DataFrame, by: Sequence[str], causes: Mapping[str, int]) -> DataFrame:
    """The sums with ``n_risk``, the weight at risk at each event time, as doubles."""
    upto = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = ["n_risk", *[f"n_{c}" for c in causes]]
    return sums.withColumn("n_risk", F.sum("net").over(upto)).withColumns({n: F.col(n).cast("double") for n in names}).drop("net")


def _ship() -> None:
    """Lets the functions of this module travel with the tasks that use them."""
    ship()
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
