"""Binomial-logit models for many groups and replicates at once by iteratively reweighted least squares.

All models, groups and replicates advance together, one Spark job per iteration.  A task
builds the design of its rows once and adds up the cross products for all replicates in
one matrix product, with a column of weights for each: rows are never copied per replicate.
The sums meet in a tree, and its last step solves for the next coefficients.  A group
of any share of the rows is thus spread over all tasks, and only coefficients
(groups x replicates x terms) reach the driver.

A row with a NULL in a model's outcome or terms takes no part in the fit of that
model and gets a NULL probability; a level that a category does not list is an error
in the fit and NULL in the prediction.
"""

from __future__ import annotations

import pickle
import sys
import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.operators import replicates
from riskline.operators.replicates import Counts, Once, chunks

# So many partial sums of a model and group meet in one step of the tree.
FAN = 32
# A partition has at least about so many rows.
PIECE = 50_000
# Rows of a packed block, and numbers (rows x replicates) that a step on one works on.
BLOCK, NUMBERS = 100_000, 1_000_000
# A number that takes no more values in a block is part of its cells.
FEW = 16
# The columns of a packed block's group and of its rows' cells.
GROUP, CELL = "_group", "_cell"
# A category column with more levels is refused.
MAX_LEVELS = 1_000


@dataclass(frozen=True)
class Spline:
    """Cubic basis on [lo, hi]; fitted values do not depend on the bounds chosen."""

    column: str
    lo: float
    hi: float


@dataclass(frozen=True)
class Numeric:
    column: str


@dataclass(frozen=True)
class Category:
    """Indicators of every level but the first."""

    column: str
    levels: tuple


Term = Spline | Numeric | Category


@dataclass(frozen=True)
class Logit:
    """One model: a 0/1 outcome column, its terms, a frequency column and its grouping."""

    name: str
    outcome: str
    terms: tuple[Term, ...] = field(default_factory=tuple)
    freq: str = "freq"
    by: tuple[str, ...] = ("rep",)

    @property
    def size(self) -> int:
        return 1 + sum(map(_width, self.terms))


def _width(t: Term) -> int:
    """Design columns of a term."""
    return {Spline: lambda: 3, Numeric: lambda: 1, Category: lambda: len(t.levels) - 1}[type(t)]()


def cubic_basis(x: Column, lo: float, hi: float) -> list[Column]:
    """Cubic Bernstein polynomials on [lo, hi] without the first."""
    u = (x - lo) / ((hi - lo) or 1.0)
    return [3 * u * (1 - u) * (1 - u), 3 * u * u * (1 - u), u * u * u]


def term_columns(terms: Sequence[Term]) -> list[Column]:
    """Design columns of the terms, in coefficient order after the intercept."""
    out: list[Column] = []
    for t in terms:
        if isinstance(t, Spline):
            out += cubic_basis(F.col(t.column), t.lo, t.hi)
        elif isinstance(t, Numeric):
            out.append(F.col(t.column).cast("double"))
        else:
            known = F.col(t.column).isin(*t.levels)
            out += [F.when(known, (F.col(t.column) == level).cast("double")) for level in t.levels[1:]]
    return out


# Fixed value: linear predictors are bounded here, so fitted probabilities stay inside (0, 1).
ETA_BOUND = 30.0


def fitted(terms: Sequence[Term], beta: Column) -> Column:
    """Fitted probability from an array column of coefficients; NULL where a term is."""
    eta = F.get(beta, F.lit(0))
    for i, x in enumerate(term_columns(terms), start=1):
        eta = eta + F.get(beta, F.lit(i)) * x
    bounded = F.greatest(F.least(eta, F.lit(ETA_BOUND)), F.lit(-ETA_BOUND))
    return F.when(eta.isNotNull(), 1 / (1 + F.exp(-bounded)))


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """Sorted distinct levels of each category column, NULL left out; two passes whatever the number of columns."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    about = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    wide = [c for c in columns if about[c] > 1.2 * MAX_LEVELS]
    if not wide:
        found = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
        wide = [c for c in columns if len(found[c]) > MAX_LEVELS]
    if wide:
        raise ValueError(f"{', '.join(wide)}: more than {MAX_LEVELS} levels")
    return {c: tuple(found[c]) for c in columns}


def cells(df: DataFrame, columns: Sequence[str], freqs: dict[str, Column]) -> DataFrame:
    """Rows collapsed to distinct covariate patterns with summed frequencies."""
    return df.groupBy(*columns).agg(*[F.sum(e).cast("bigint").alias(n) for n, e in freqs.items()])


def _code(column: str) -> str:
    return f"{column}__code"


def coded(df: DataFrame, models: Sequence[Logit], keep: Sequence[str] = ()) -> DataFrame:
    """The columns the models read and those of ``keep``, categories as positions in their level list.

    Only numbers then travel to the tasks that add up cross products.
    """
    plain = {*keep, *(c for m in models for c in (m.outcome, m.freq, *m.by) if c in df.columns)}
    terms = [t for m in models for t in m.terms]
    plain |= {t.column for t in terms if not isinstance(t, Category)}
    return df.select(*sorted(plain), *[c.alias(n) for n, c in sorted(_positions(terms).items())])


def _positions(terms: Sequence[Term]) -> dict[str, Column]:
    """Positions of the categories in their level list by name of the coded column, -1 for a level that is not listed."""
    out = {}
    for t in terms:
        if isinstance(t, Category):
            position = F.array_position(F.array(*[F.lit(v) for v in t.levels]), F.col(t.column))
            out[_code(t.column)] = (position - 1).cast("smallint")
    return out


def probabilities(models: Sequence[Logit], beta: Mapping[int, Mapping[str, Sequence[float] | None]], stratum: str = "exposed") -> Column:
    """Struct of the ``fitted`` probabilities of all models, from their coefficients in each stratum; NULL where there are none.

    One product of matrices for each model: as expressions on columns they make a method that the JVM does not compile.
    """
    ship()
    terms = [t for m in models for t in m.terms]
    plain = dict.fromkeys([stratum, *(t.column for t in terms if not isinstance(t, Category))])
    known = {n: F.when(c >= 0, c) for n, c in _positions(terms).items()}
    given = F.struct(*[c.cast("double").alias(n) for n, c in ({n: F.col(n) for n in plain} | known).items()])
    names = [m.name for m in models]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        blocks: dict = {}
        own = rows[stratum].to_numpy(float)
        out = np.full((len(names), len(rows)), np.nan)
        for k, m in enumerate(models):
            x = _design(rows, m.terms, blocks)
            for s, found in beta.items():
                if found.get(m.name) is not None:
                    eta = np.clip(x @ np.asarray(found[m.name]), -ETA_BOUND, ETA_BOUND)
                    out[k] = np.where(own == s, 1.0 / (1.0 + np.exp(-eta)), out[k])
        return pd.DataFrame(dict(zip(names, out, strict=True)))

    return score(given)


def _design(pdf: pd.DataFrame, terms: Sequence[Term], blocks: dict | None = None) -> np.ndarray:
    """Design matrix of coded rows, a column at a time in memory; ``blocks`` keeps the columns of terms shared by several models."""
    blocks = {} if blocks is None else blocks
    for t in terms:
        if t in blocks:
            continue
        if isinstance(t, Category):
            x = pdf[_code(t.column)].to_numpy(float)
            if (x < 0).any():
                raise ValueError(f"{t.column} has a level that the model does not list")
            block = (x == np.arange(1, len(t.levels))[:, None]).astype(float)
            block[:, np.isnan(x)] = np.nan
            blocks[t] = block
        elif isinstance(t, Spline):
            u = (pdf[t.column].to_numpy(float) - t.lo) / ((t.hi - t.lo) or 1.0)
            blocks[t] = np.vstack([3 * u * (1 - u) ** 2, 3 * u**2 * (1 - u), u**3])
        else:
            blocks[t] = pdf[t.column].to_numpy(float)[None, :]
    return np.vstack([np.ones((1, len(pdf))), *[blocks[t] for t in terms]]).T


@dataclass(frozen=True)
class _Factored:
    """A design of rows in runs, the cells: ``own`` (columns x rows) and ``shared`` (columns x cells), which is equal all through a cell.

    ``cell`` is each row's cell, ascending from 0; ``order`` the places in the model of the columns of ``own``, then of ``shared``.
    """

    own: np.ndarray
    shared: np.ndarray
    cell: np.ndarray
    order: np.ndarray

    def __len__(self) -> int:
        return len(self.cell)

    def __getitem__(self, kept: np.ndarray) -> _Factored:
        cell = self.cell[kept]
        new = _breaks(cell)
        return _Factored(self.own[:, kept], self.shared[:, cell[new]], np.cumsum(new) - 1, self.order)

    def known(self) -> np.ndarray | None:
        """Which rows have all terms; None if no term is missing."""
        if not np.isnan(self.own.sum() + self.shared.sum()):
            return None
        return ~(np.isnan(self.own).any(axis=0) | np.isnan(self.shared).any(axis=0)[self.cell])


def _breaks(cell: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its cell."""
    return np.r_[True, cell[1:] != cell[:-1]][: len(cell)]


class _Cells:
    """The rows of a packed block, from which the designs of several models are made."""

    def __init__(self, rows: pd.DataFrame):
        self.rows, new = rows, _breaks(rows[CELL].to_numpy())
        self.cell = np.cumsum(new) - 1
        self.firsts = rows.iloc[np.flatnonzero(new)]
        self.equal: dict[str, bool] = {}
        self.blocks: tuple[dict, dict] = ({}, {})

    def _by_cell(self, t: Term) -> bool:
        """Whether the term is equal all through every cell, as categories are."""
        if isinstance(t, Numeric) and t.column not in self.equal:
            given = self.rows[t.column].to_numpy(float)
            self.equal[t.column] = np.array_equal(given, self.firsts[t.column].to_numpy(float)[self.cell], equal_nan=True)
        return isinstance(t, Category) or isinstance(t, Numeric) and self.equal[t.column]

    def design(self, terms: Sequence[Term]) -> _Factored:
        shared = [self._by_cell(t) for t in terms]
        places = np.split(np.arange(1, 1 + sum(map(_width, terms))), np.cumsum([_width(t) for t in terms])[:-1])
        own = _design(self.rows, [t for t, s in zip(terms, shared, strict=True) if not s], self.blocks[0]).T[1:]
        common = _design(self.firsts, [t for t, s in zip(terms, shared, strict=True) if s], self.blocks[1]).T
        order = [*[p for p, s in zip(places, shared) if not s], [0], *[p for p, s in zip(places, shared) if s]]
        return _Factored(own, common, self.cell, np.concatenate(order).astype(int))


def _cross_products(x: np.ndarray | _Factored, y: np.ndarray, freq: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """A column for each replicate: the upper triangle of X'WX, X'(W eta + y - mu) and the deviance at its row of ``beta``.

    ``freq`` is rows x replicates.  What the columns that are equal in a cell add is summed by cell first, so their
    products cost by cells and not by rows.
    """
    if isinstance(x, np.ndarray):
        x = _Factored(np.ascontiguousarray(x.T), np.empty((0, min(1, len(x)))), np.zeros(len(x), int), np.arange(x.shape[1]))
    own, shared, n = x.own, x.shared, len(x.own)
    freq, beta = np.ascontiguousarray(freq.T, float), beta[:, x.order]
    firsts = np.flatnonzero(_breaks(x.cell))
    eta = np.clip(beta[:, :n] @ own + np.take(beta[:, n:] @ shared, x.cell, axis=1), -ETA_BOUND, ETA_BOUND)
    small = np.exp(-np.abs(eta))
    mu = np.where(eta >= 0, 1.0, small) / (1.0 + small)
    w = freq * mu * (1.0 - mu)
    # The logarithm of 1 + exp(eta), or of 1 + exp(-eta) where there was an event.
    deviance = 2.0 * np.sum(freq * (np.log1p(small) + np.maximum(np.where(y == 1, -eta, eta), 0.0)), axis=1)
    right = w * eta + freq * (y - mu)
    square = np.zeros((len(beta), n + len(shared), n + len(shared)))
    for k, column in enumerate(own):
        weighted = w * column
        square[:, k, k:n] = weighted @ own[k:].T
        if len(shared):
            square[:, k, n:] = np.add.reduceat(weighted, firsts, axis=1) @ shared.T
    if len(shared):
        for r, by_cell in enumerate(np.add.reduceat(w, firsts, axis=1)):
            square[r, n:, n:] = (shared * by_cell) @ shared.T
    sums = np.hstack([right @ own.T, np.add.reduceat(right, firsts, axis=1) @ shared.T])
    # In the order of the model; a product above the diagonal may come from below it.
    i, j = np.triu_indices(len(x.order))
    back = np.argsort(x.order)
    i, j = back[i], back[j]
    return np.vstack([square[:, np.minimum(i, j), np.maximum(i, j)].T, sums[:, back].T, deviance])


def _newton_steps(total: np.ndarray, p: int) -> np.ndarray:
    """Next coefficients, a row for each column of summed cross products; a rank-deficient system gets its shortest solution."""
    i, j = np.triu_indices(p)
    out = np.empty((total.shape[1], p))
    for r, column in enumerate(total.T):
        left = np.empty((p, p))
        left[i, j] = left[j, i] = column[: len(i)]
        out[r] = np.linalg.lstsq(left, column[len(i) : len(i) + p], rcond=1e-12)[0]
    return out


class _Fit:
    """Where the replicates of one model and group stand."""

    def __init__(self, size: int, p: int):
        self.beta, self.last = np.zeros((size, p)), np.zeros((size, p))
        self.deviance, self.open = np.full(size, np.nan), np.ones(size, bool)

    def advance(self, step: np.ndarray, deviance: np.ndarray, tol: float) -> None:
        """Takes the steps of the open replicates; one that raised the deviance is halved, a settled one is the last."""
        at = np.flatnonzero(self.open)
        change = deviance - self.deviance[at]
        settled = np.abs(change) / (np.abs(deviance) + 0.1) < tol
        worse = (change > 0) & ~settled
        back = at[worse]
        self.beta[back] = (self.beta[back] + self.last[back]) / 2
        on = at[~worse]
        self.last[on], self.deviance[on], self.beta[on] = self.beta[on], deviance[~worse], step[~worse]
        self.open[at[settled]] = False


def fit_logits(
    data: DataFrame, models: Sequence[Logit], max_iter: int = 40, tol: float = 1e-9, counts: Counts | None = None
) -> dict[tuple, np.ndarray]:
    """Coefficients of every model in every group, keyed ``(name, *group)``.

    ``data`` should be a written table, as every iteration reads it.  With ``counts`` all its
    replicates are fitted, a row of coefficients each; a model's frequency is then
    multiplied by the multiplicities.  A step that raises the deviance is halved.  Groups
    that have not settled after ``max_iter`` iterations are named in a warning.
    """
    # The small helpers travel with the tasks, so executors need no copy of this package.
    ship()
    drawn = counts or Once()
    tasks = pieces(data)
    finest = sorted({c for m in models for c in m.by if c in data.columns})
    # Spread evenly by rows and held: the files behind it are few and uneven, as they compress well.
    data = _blocks(coded(data, models, drawn.columns).repartition(tasks), finest, drawn.size, [t for m in models for t in m.terms]).persist()
    spec = {m.name: m for m in models}
    context = data.sparkSession.sparkContext
    fits: dict[tuple, _Fit] = {}
    places = {m.name: [finest.index(c) for c in m.by if c in finest] for m in models}
    kind = "model string, key array<int>, part int, v binary"
    live = list(models)

    for _ in range(max_iter):
        state = context.broadcast({k: (f.beta[f.open], np.flatnonzero(f.open)) for k, f in fits.items()})

        def partials(batches: Iterator[pa.RecordBatch], live: Sequence[Logit] = live) -> Iterator[pa.RecordBatch]:
            current = state.value
            sums: dict[tuple, np.ndarray] = {}
            for group, part in _unpacked(batches):
                times, cells = None, _Cells(part)
                for m in live:
                    key = (m.name, *[group[i] for i in places[m.name]])
                    beta, open_ = current.get(key) or (np.zeros((drawn.size, m.size)), np.arange(drawn.size))
                    own = part[m.freq].to_numpy(float)
                    if not len(open_) or not own.any():
                        continue
                    times = drawn.matrix(part) if times is None else times
                    x, y = cells.design(m.terms), part[m.outcome].to_numpy(float)
                    freq = own[:, None] * (times if len(open_) == drawn.size else times[:, open_])
                    whole = ~np.isnan(y) & (own != 0)
                    if (known := x.known()) is not None:
                        whole &= known
                    if not whole.all():
                        x, y, freq = x[whole], y[whole], freq[whole]
                    now = _cross_products(x, y, freq, beta)
                    sums[key] = sums[key] + now if key in sums else now
            if sums:
                yield _sums([(k[0], list(k[1:]), TaskContext.get().partitionId(), v.tobytes()) for k, v in sums.items()])

        def add(table: pa.Table) -> pa.Table:
            row = table.slice(0, 1).to_pylist()[0]
            return pa.Table.from_batches([_sums([(row["model"], row["key"], row["part"], _added(table).tobytes())])])

        def solve(table: pa.Table) -> pa.Table:
            row = table.slice(0, 1).to_pylist()[0]
            p = spec[row["model"]].size
            total = _added(table).reshape(p * (p + 1) // 2 + p + 1, -1)
            made = np.column_stack([total[-1], _newton_steps(total, p)])
            return pa.Table.from_batches([_sums([(row["model"], row["key"], 0, made.tobytes())])])

        # Settled models are passed over, and the columns that only they read.
        steps, left = data.select(GROUP, CELL, *_read(data, live, drawn.columns)).mapInArrow(partials, kind), tasks
        while left > FAN:
            steps = steps.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("model", "key", "part").applyInArrow(add, kind)
            left = -(-left // FAN)
        for row in steps.groupBy("model", "key").applyInArrow(solve, kind).select("model", "key", "v").collect():
            p = spec[row["model"]].size
            fit = fits.setdefault((row["model"], *row["key"]), _Fit(drawn.size, p))
            made = np.frombuffer(row["v"]).reshape(-1, p + 1)
            fit.advance(made[:, 1:], made[:, 0], tol)
        state.unpersist()
        still = {k[0] for k, f in fits.items() if f.open.any()}
        live = [m for m in models if m.name in still]
        if not live:
            break
    data.unpersist()
    if open_ := sorted(k for k, f in fits.items() if f.open.any()):
        warnings.warn(f"not converged after {max_iter} iterations: {open_}", stacklevel=2)
    return {k: f.beta if counts else f.beta[0] for k, f in fits.items()}


def _blocks(data: DataFrame, finest: Sequence[str], size: int, terms: Sequence[Term]) -> DataFrame:
    """Rows of ``data`` packed by the values of ``finest``: a row holds those values and, for each column, the numbers of up to BLOCK rows.

    The rows of a block stand by their cell, the values of its categories and of numbers that take few values in it.
    Every pass then takes whole blocks from where they are held, no row is turned into Arrow or pandas a second
    time.  Rows with a NULL in ``finest`` are in no group.
    """
    codes = dict.fromkeys(_code(t.column) for t in terms if isinstance(t, Category))
    plain = dict.fromkeys(t.column for t in terms if isinstance(t, Numeric))

    def by_cell(part: pd.DataFrame) -> pd.DataFrame:
        cell = np.zeros(len(part), np.int64)
        for c in (*codes, *plain):
            at, found = pd.factorize(part[c].to_numpy())
            if c in codes or len(found) <= FEW:
                cell = pd.factorize(cell * (len(found) + 1) + at + 1)[0]
        order = np.argsort(cell, kind="stable")
        return part.iloc[order].assign(**{CELL: cell[order]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(chunks(batches, size), max(64, min(BLOCK, NUMBERS // size))):
            for group, part in rows.groupby(list(finest), sort=False) if finest else [((), rows)]:
                part = by_cell(part)
                held = [pa.array([[int(v) for v in group]], pa.list_(pa.int32())), *[pa.array([_packed(part[c])], pa.binary()) for c in part]]
                yield pa.RecordBatch.from_arrays(held, [GROUP, *part])

    return data.mapInArrow(pack, ", ".join([f"{GROUP} array<int>", *[f"`{c}` binary" for c in (*data.columns, CELL)]]))


def _gathered(parts: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The parts put together until they have ``most`` rows."""
    held: list[pd.DataFrame] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= most:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _packed(values: pd.Series) -> bytes:
    """The numbers in their narrowest type, whose letter stands at the end; anything else pickled."""
    a = values.to_numpy()
    if a.dtype.kind not in "biuf":
        return pickle.dumps(a.tolist()) + b"O"
    if a.dtype.kind in "iu":
        a = a.astype(next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= a.min() and a.max() <= np.iinfo(t).max))
    return a.tobytes() + a.dtype.char.encode()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], pd.DataFrame]]:
    """(group, rows) of the blocks."""
    for batch in batches:
        names = batch.schema.names[1:]
        for k in range(batch.num_rows):
            part = {}
            for i, name in enumerate(names, start=1):
                v = batch.column(i)[k].as_py()
                kind = np.dtype(chr(v[-1]))
                part[name] = pickle.loads(v[:-1]) if kind == object else np.frombuffer(v, kind, count=(len(v) - 1) // kind.itemsize)
            yield batch.column(0)[k].as_py(), pd.DataFrame(part, copy=False)


def pieces(data: DataFrame) -> int:
    """Partitions that spread the rows of a written table evenly over the cores: two for each, or more if its files make more; few rows make few."""
    most = max(2 * data.sparkSession.sparkContext.defaultParallelism, data.rdd.getNumPartitions())
    return max(1, min(most, -(-data.count() // PIECE)))


def _read(data: DataFrame, models: Sequence[Logit], more: Sequence[str]) -> list[str]:
    """The columns of coded ``data`` that the models and ``more`` read."""
    own = {*more, *(c for m in models for c in (m.outcome, m.freq, *m.by))}
    own |= {_code(t.column) if isinstance(t, Category) else t.column for m in models for t in m.terms}
    return [c for c in data.columns if c in own]


def ship() -> None:
    """Lets the functions of this module travel with the tasks that use them."""
    for module in (sys.modules[__name__], replicates):
        cloudpickle.register_pickle_by_value(module)


def _sums(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"model": pa.string(), "key": pa.list_(pa.int32()), "part": pa.int32(), "v": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _added(table: pa.Table) -> np.ndarray:
    """The sum of the flat arrays in ``v``."""
    total = None
    for v in table["v"]:
        one = np.frombuffer(v.as_py())
        total = one.copy() if total is None else total + one
    return total


def marginal_prob(df: DataFrame, outcome: str, freq: Column, by: Sequence[str] = ("rep",)) -> DataFrame:
    """Fitted value of the intercept-only model: the weighted mean per group."""
    return df.groupBy(*by).agg((F.sum(F.col(outcome) * freq) / F.sum(freq)).alias("p_marginal"))
