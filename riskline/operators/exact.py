"""Second moments over people at every time, without rounding.

A person's influence on a curve is piecewise linear in curve functions g: ``o + w g(t)`` while at
risk, and a constant ``e`` after a row until the next one.  The sum of its squares over people
is a sum of products that enter and leave, and what is left may be smaller by many orders
than what has passed through.  Products of floating-point numbers are integers times a power of
two, so they are added up as integers: in the tasks by time, between tasks as
32-bit limbs that any sum of long integers combines, and along time once more.  Only the final value is
rounded, and as a sum of squares it is never negative.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskline.operators.lineage import written

#: Limbs of a sum and bits of a limb: numbers count down to 2 ** -320 of the largest.
LIMBS, BITS = 10, 32
#: Binary places of the curve functions when products are put together.
PLACES = 200


def pairs(parts: Sequence[str]) -> list[tuple[str, str]]:
    """The products of parts that a variance takes: with the first part, and with itself."""
    return [(parts[0], p) for p in parts] + [(p, p) for p in parts[1:]]


def _terms(parts: Sequence[str]) -> list[str]:
    both = [f"{p}_{r}" for p, r in pairs(parts)]
    return ["w2", *[f"wo_{p}" for p in parts], *[f"oo_{b}" for b in both], *[f"ee_{b}" for b in both]]


def _whole(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Mantissas and binary exponents of floating-point numbers."""
    mantissa, exponent = np.frexp(values)
    return (mantissa * 2.0**53).astype(np.int64).tolist(), (exponent - 53).tolist()


def _products(rows: pd.DataFrame, parts: Sequence[str], unit: int) -> Iterator[tuple[list[int], list[int]]]:
    """For each row the terms while it is at risk and after it, as integers in units of ``2 ** unit``."""
    number = {c: _whole(rows[c].to_numpy(float)) for c in ("w", *[f"{k}_{p}" for p in parts for k in "oe"])}

    def product(a: str, b: str, i: int) -> int:
        (x, ex), (y, ey) = number[a], number[b]
        shift, value = ex[i] + ey[i] - unit, x[i] * y[i]
        return value << shift if shift >= 0 else value >> -shift

    for i in range(len(rows)):
        live = [product("w", "w", i), *[product("w", f"o_{p}", i) for p in parts], *[product(f"o_{p}", f"o_{r}", i) for p, r in pairs(parts)]]
        yield live, [product(f"e_{p}", f"e_{r}", i) for p, r in pairs(parts)]


def moments(rows: DataFrame, by: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(by, time, limbs of every term) of the changes at each time; the unit is in ``unit``.

    ``rows`` is a written table with ``start``, ``stop``, ``next`` (NULL after a person's last row), ``w``,
    and ``o_<part>``, ``e_<part>``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    by, parts = list(by), list(parts)
    largest = rows.agg(F.max(F.greatest(*[F.abs(c) for c in ("w", *[f"{k}_{p}" for p in parts for k in "oe"])]))).first()[0]
    unit = 2 * math.frexp(largest or 1.0)[1] - LIMBS * BITS
    names = [f"{t}_{k}" for t in _terms(parts) for k in range(LIMBS)]
    schema = T.StructType(
        [rows.schema[c] for c in by] + [T.StructField("time", T.DoubleType())] + [T.StructField(n, T.LongType()) for n in names]
    )
    n_live, n_all = 1 + len(parts) + len(pairs(parts)), len(_terms(parts))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            part = batch.to_pandas()
            keys = list(zip(*[part[c] for c in by], strict=True)) if by else [()] * len(part)
            times = zip(part["start"].tolist(), part["stop"].tolist(), part["next"].tolist(), strict=True)
            for key, (start, stop, after), (live, rest) in zip(keys, times, _products(part, parts, unit), strict=True):
                enter = sums.setdefault((*key, start), [0] * n_all)
                leave = sums.setdefault((*key, stop), [0] * n_all)
                for k, v in enumerate(live):
                    enter[k] += v
                    leave[k] -= v
                again = sums.setdefault((*key, after), [0] * n_all) if after == after and after is not None else None
                for k, v in enumerate(rest, start=n_live):
                    leave[k] += v
                    if again is not None:
                        again[k] -= v
        kinds, found = to_arrow_schema(schema), list(sums.items())
        for i in range(0, len(found), 5_000):
            some = found[i : i + 5_000]
            columns = [list(c) for c in zip(*[k for k, _ in some], strict=True)]
            columns += [[_limb(v[t], k) for _, v in some] for t in range(n_all) for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    changes = rows.mapInArrow(add, schema).groupBy(*by, "time").agg(*[F.sum(n).alias(n) for n in names])
    return changes.withColumn("unit", F.lit(unit))


def _limb(value: int, k: int) -> int:
    """Limb ``k`` of an integer; the last one carries the sign."""
    return value >> (BITS * k) if k == LIMBS - 1 else (value >> (BITS * k)) & ((1 << BITS) - 1)


def variances(curve: DataFrame, changes: DataFrame, by: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """``curve`` with ``var_<part>`` for all parts but the first: the sum over people of ``(P - F Q) ** 2`` at each time.

    ``curve`` has ``time``, ``g_<part>`` for all and ``risk_<part>`` (F) for all but the first part, Q.  The times of a
    group are passed in order in one task, as the curve's own running sums are.
    """
    by, parts = list(by), list(parts)
    table = written(curve.join(changes, [*by, "time"]), "moments")
    kept = [f for f in table.schema if f.name in curve.columns]
    schema = T.StructType([*kept, *[T.StructField(f"var_{p}", T.DoubleType()) for p in parts[1:]]])
    terms = _terms(parts)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("time")
        if not group.num_rows:
            return pa.Table.from_pylist([], schema=to_arrow_schema(schema))
        limbs = {t: [group[f"{t}_{k}"].to_pylist() for k in range(LIMBS)] for t in terms}
        number = {c: group[c].to_pylist() for p in parts for c in (f"g_{p}", f"risk_{p}") if c in group.column_names}
        scale = group["unit"][0].as_py() - 4 * PLACES
        at, out = dict.fromkeys(terms, 0), {p: [] for p in parts[1:]}
        for i in range(group.num_rows):
            for t in terms:
                at[t] += sum(limb[i] << (BITS * k) for k, limb in enumerate(limbs[t]))
            g = {p: _fixed(number[f"g_{p}"][i]) for p in parts}

            def second(p: str, r: str) -> int:
                linear = g[p] * at[f"wo_{r}"] + g[r] * at[f"wo_{p}"]
                return ((at[f"oo_{p}_{r}"] + at[f"ee_{p}_{r}"]) << 2 * PLACES) + (linear << PLACES) + g[p] * g[r] * at["w2"]

            q = parts[0]
            for p in parts[1:]:
                risk = _fixed(number[f"risk_{p}"][i])
                total = (second(p, p) << 2 * PLACES) - ((2 * risk * second(q, p)) << PLACES) + risk * risk * second(q, q)
                out[p].append(total / (1 << -scale) if scale < 0 else float(total << scale))
        columns = [group[f.name].combine_chunks() for f in kept] + [pa.array(out[p], pa.float64()) for p in parts[1:]]
        return pa.Table.from_arrays(columns, schema=to_arrow_schema(schema))

    return (table.groupBy(*by) if by else table.groupBy(F.lit(0))).applyInArrow(run, schema)


def _fixed(value: float | None) -> int:
    """A number in units of ``2 ** -PLACES``; missing ones count as zero."""
    if value is None:
        return 0
    top, bottom = value.as_integer_ratio()
    return (top << PLACES) // bottom
