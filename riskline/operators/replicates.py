"""Multiplicities of people in bootstrap replicates, computed beside the rows in the tasks that read them.

Nothing here needs the rest of the package: the objects travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

#: Numbers (rows x replicates) and rows that one step of a task works on.
CELLS, ROWS = 400_000, 8_000


@dataclass(frozen=True)
class Poisson:
    """Counts that are functions of two hash words of the person; replicate 0 counts everybody once."""

    coefficients: tuple[tuple[int, int, int], ...]
    steps: tuple[int, ...]
    modulus: int
    columns: tuple[str, ...] = ("_h1", "_h2")

    @property
    def size(self) -> int:
        return len(self.coefficients)

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        """Rows x replicates; words that stand in a row of equal ones are drawn for once."""
        words = rows[list(self.columns)].to_numpy(np.int64)
        new = np.r_[True, (words[1:] != words[:-1]).any(axis=1)][: len(words)]
        a, c, b = np.array(self.coefficients, np.int64).T
        x = (words[new, :1] * a + words[new, 1:] * c + b) % self.modulus
        return np.searchsorted(np.array(self.steps), x, side="right")[np.cumsum(new) - 1]


@dataclass(frozen=True)
class Listed:
    """Counts that stand in a binary column, two bytes for each replicate."""

    size: int
    columns: tuple[str, ...] = ("_drawn",)

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        flat = np.frombuffer(b"".join(rows[self.columns[0]]), ">u2")
        return flat.reshape(len(rows), self.size).astype(np.int64)


@dataclass(frozen=True)
class Once:
    """The rows as they are: one replicate in which everybody counts once."""

    size: int = 1
    columns: tuple[str, ...] = ()

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        return np.ones((len(rows), 1), np.int64)


Counts = Poisson | Listed | Once


def chunks(batches: Iterator[pa.RecordBatch], size: int, key: str | None = None) -> Iterator[pd.DataFrame]:
    """The rows of a partition in pieces of at most ROWS rows, about ``CELLS`` / ``size`` of them; with ``key`` no piece ends inside a run of equal keys.

    A run of equal keys is held whole, however long.
    """
    most, held = min(ROWS, max(64, CELLS // size)), None
    for batch in batches:
        rows = batch.to_pandas()
        if held is not None:
            rows, held = pd.concat([held, rows], ignore_index=True), None
        if key is None:
            ends = [*range(most, len(rows), most), len(rows)]
        else:
            ids = rows[key].to_numpy()
            breaks = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            last = int(breaks[-1]) if len(breaks) else 0
            held, rows = rows.iloc[last:].reset_index(drop=True), rows.iloc[:last]
            ends, at = [], 0
            while at < last:  # the last break within reach, or else the next one
                k = int(np.searchsorted(breaks, at + most, side="right"))
                at = int(breaks[k - 1]) if k and breaks[k - 1] > at else int(breaks[k])
                ends.append(at)
        at = 0
        for end in ends:
            if end > at:
                yield rows.iloc[at:end].reset_index(drop=True)
            at = end
    if held is not None and len(held):
        yield held
