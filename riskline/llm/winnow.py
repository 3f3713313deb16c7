"""Content-defined runs of the fixed-size windows of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Odd multiplier of the rolling hash modulo 2^64, and those of the final mix (fixed values).
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2^64 for i below n."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """64-bit hashes of any slices of a text, from one pass over it."""

    _up, _down = _powers(1 << 16)

    def __init__(self, text: np.ndarray):
        if len(text) + 1 > len(Rolling._up):
            Rolling._up, Rolling._down = _powers(2 * len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * Rolling._down[: len(text)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        h = (self.sums[stops] - self.sums[starts]) * Rolling._up[starts]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
        h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
        return h ^ (h >> np.uint64(31))


def _sliding(best: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = best(a[:-step], a[step:])
        done += step
    return a


#: Places of a run's hash up to which all their distances are tried.
TRIED = 8


def _repeats(run: np.ndarray, at: np.ndarray, window: int) -> bool:
    """Whether a run may hold two equal windows, whose distance is then one of those between the places of its hash."""
    if len(at) > TRIED:
        return True
    for d in {int(b - a) for i, a in enumerate(at) for b in at[i + 1 :]}:
        other = np.flatnonzero(run[:-d] != run[d:])
        if (np.diff(np.r_[-1, other, len(run) - d]) > window).any():
            return True
    return False


@dataclass
class Runs:
    """Runs of neighbouring windows with one smallest hash of their grams, as arrays."""

    owner: np.ndarray
    first: np.ndarray
    last: np.ndarray
    seg: np.ndarray
    again: np.ndarray
    several: np.ndarray
    left: np.ndarray
    right: np.ndarray


def runs(text: np.ndarray, window: int, gram: int) -> Runs:
    """The runs of a text's windows.

    ``owner`` is the smallest ``gram``-byte hash.  It depends on a window's bytes alone, so
    equal windows of any texts are in runs with the same owner.  ``first`` and ``last`` are the
    run's first and last window, ``seg`` hashes its bytes.  ``several`` tells whether the
    owner stands at more than one place in the run, and ``again`` whether the run may
    hold equal windows itself.  ``left`` and ``right`` hash the bytes before and after the
    owner's place, half of what a window has beside it, -1 where the text ends before: equal windows
    of runs with one place each agree in one of the two.
    """
    if len(text) < window:
        none = np.zeros(0, np.int64)
        return Runs(none.view(np.uint64), none, none, none.view(np.uint64), none.astype(bool), none.astype(bool), none, none)
    rolling = Rolling(text)
    at = np.arange(len(text) - gram + 1)
    hashes, width = rolling.of(at, at + gram), window - gram + 1
    least = _sliding(np.minimum, hashes, width)
    firsts = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
    lasts = np.r_[firsts[1:] - 1, len(least) - 1]
    value = least[firsts]
    # A place has the smallest hash of some window if it equals the greatest of its windows' smallest.
    beyond = np.zeros(width - 1, np.uint64)
    owners = np.flatnonzero(hashes == _sliding(np.maximum, np.concatenate([beyond, least, beyond]), width))
    low, high = np.searchsorted(owners, firsts), np.searchsorted(owners, lasts + width)
    place = low.copy()
    while len(other := np.flatnonzero(hashes[owners[place]] != value)):
        place[other] += 1
    following = np.minimum(place + 1, len(owners) - 1)
    several = (place + 1 < high) & (hashes[owners[following]] == value)
    again = several.copy()
    for r in np.flatnonzero(several):
        own = owners[low[r] : high[r]]
        again[r] = _repeats(text[firsts[r] : lasts[r] + window], own[hashes[own] == value[r]], window)
    p, half = owners[place], (window - gram) // 2
    before, after = p >= half, p + gram + half <= len(text)
    left, right = np.full(len(p), -1), np.full(len(p), -1)
    left[before] = (rolling.of(p[before] - half, p[before]) >> np.uint64(48)).astype(np.int64)
    right[after] = (rolling.of(p[after] + gram, p[after] + gram + half) >> np.uint64(48)).astype(np.int64)
    return Runs(value, firsts, lasts, rolling.of(firsts, lasts + window), again, several, left, right)
