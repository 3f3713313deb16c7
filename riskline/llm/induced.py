"""External induced sorting of the suffixes of one text, with their common prefixes.

The text lies in a mapped file.  Its leftmost smaller suffixes are sorted by their
substrings and named; where names repeat, the string of names is sorted the
same way, one level deeper.  From their order the larger suffixes are induced,
and from those the smaller ones: a suffix that leaves the queue puts the one
before it in, with the length of the prefix that it shares with the last one put
in for the same symbol.  That is one more than the smallest shared length among
the suffixes that left in between.

Symbols leave the queue in order, and suffixes of one symbol in the order in which
they came, so the queue is a row of first-in first-out files with a heap of their
symbols.  It holds a bounded number of tuples in memory and the rest on disk, and
all arrays as long as the text are mapped files: memory does not follow the
text.  A block of tuples is handled at once where the text is of bytes; names are
many and rare, so deeper levels go tuple by tuple.  A level whose names are fewer than
half the tuples that a queue holds needs no files: it is sorted in memory, by ranks of
doubled lengths.  Shared lengths are counted up to a cap.
"""

from __future__ import annotations

import mmap
import os
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np

#: Tuples that a queue holds in memory, and that are handled at once.
HELD, BLOCK = 2_000_000, 1 << 15
#: Shared lengths take the low bits of a tuple.
BITS = 8
CAP = (1 << BITS) - 1


class Folder:
    """Unnamed files of one task."""

    def __init__(self, path: str):
        self.path, self.n = path, 0

    def file(self):
        """An open file that goes with its last reference."""
        self.n += 1
        name = os.path.join(self.path, f"{os.getpid()}-{self.n}")
        file = open(name, "w+b")  # noqa: SIM115
        os.unlink(name)
        return file

    def zeros(self, size: int, kind) -> np.ndarray:
        """A mapped array of zeros."""
        with self.file() as f:
            f.truncate(max(1, size) * np.dtype(kind).itemsize)
            return np.frombuffer(mmap.mmap(f.fileno(), 0), kind, size)


class Row:
    """A growing sequence of integers, in a file beyond a block."""

    def __init__(self, folder: Folder):
        self.folder, self.tail, self.size, self.file = folder, array("q"), 0, None

    def extend(self, values) -> None:
        """Adds 64-bit integers from an array or anything else with a buffer of them."""
        self.tail.frombytes(values.astype(np.int64, copy=False).tobytes() if isinstance(values, np.ndarray) else values.tobytes())
        if len(self.tail) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.file is None:
            self.file = self.folder.file()
        self.tail.tofile(self.file)
        self.size += len(self.tail)
        self.tail = array("q")

    def view(self) -> np.ndarray:
        if self.file is None:
            return np.array(self.tail, np.int64)
        if self.tail:
            self._flush()
        self.file.flush()
        return np.frombuffer(mmap.mmap(self.file.fileno(), 0), np.int64, self.size)


class Queue:
    """Monotone priority queue of (symbol, tuple): by symbol, and in order of arrival for one symbol."""

    def __init__(self, folder: Folder, falling: bool):
        self.folder, self.sign = folder, -1 if falling else 1
        self.order: list[int] = []
        self.tails: dict[int, array] = {}
        self.files: dict[int, list] = {}
        self.held = 0

    def open(self, symbol: int) -> array:
        """The end of the file of a symbol that has none in memory."""
        if symbol not in self.files:
            heappush(self.order, self.sign * symbol)
        tail = self.tails[symbol] = array("q")
        return tail

    def push(self, symbols: np.ndarray, tuples: np.ndarray) -> None:
        """Puts tuples in, those of a symbol in the order given."""
        order = np.argsort(symbols, kind="stable")
        symbols, tuples = symbols[order], tuples[order]
        edges = np.r_[0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, len(symbols)].tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                symbol = int(symbols[a])
                tail = self.tails.get(symbol)
                (self.open(symbol) if tail is None else tail).frombytes(tuples[a:b].tobytes())
        self.settle(len(tuples))

    def settle(self, pushed: int) -> None:
        """Counts tuples put in, and moves them to disk if they are too many."""
        self.held += pushed
        if self.held > HELD:
            file, at = self.folder.file(), 0
            for symbol, tail in self.tails.items():
                tail.tofile(file)
                self.files.setdefault(symbol, []).append((file, at, len(tail)))
                at += 8 * len(tail)
            file.flush()
            self.tails, self.held = {}, 0

    def top(self) -> int | None:
        """The next symbol, or None."""
        while self.order:
            symbol = self.sign * self.order[0]
            if symbol in self.tails or symbol in self.files:
                return symbol
            heappop(self.order)
        return None

    def blocks(self, symbol: int) -> Iterator:
        """All tuples of the symbol, also those that come meanwhile, as buffers of 64-bit integers."""
        while True:
            if symbol in self.files:
                for file, at, n in self.files.pop(symbol):
                    for k in range(0, n, BLOCK):
                        yield memoryview(os.pread(file.fileno(), 8 * min(BLOCK, n - k), at + 8 * k)).cast("q")
            elif symbol in self.tails:
                tail = self.tails.pop(symbol)
                self.held -= len(tail)
                if len(tail) <= BLOCK:
                    yield tail
                else:
                    whole = memoryview(tail)
                    for k in range(0, len(tail), BLOCK):
                        yield whole[k : k + BLOCK]
            else:
                return


def _types(text: np.ndarray, folder: Folder) -> np.ndarray:
    """1 where a suffix is smaller than the next one, else 0."""
    n = len(text)
    small = folder.zeros(n, np.uint8)
    state = 0
    for b in range(n, 0, -BLOCK):
        a = max(0, b - BLOCK)
        here, after = text[a:b], text[a + 1 : b + 1]
        rise = np.zeros(b - a, np.int8)
        rise[: len(after)] = np.sign(after.astype(np.int64) - here[: len(after)])
        if b == n:
            rise[-1] = -1
        # Symbols equal to the next one are as that one is.
        known = np.where(rise != 0, np.arange(b - a), b - a)
        source = np.minimum.accumulate(known[::-1])[::-1]
        small[a:b] = np.where(source < b - a, rise[np.minimum(source, b - a - 1)] > 0, state)
        state = small[a]
    return small


def _same_run(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """How many symbols equal to the first both suffixes begin with."""
    x, y = text[a : a + cap], text[b : b + cap]
    m = min(len(x), len(y))
    other = np.flatnonzero((x[:m] != x[0]) | (y[:m] != x[0]))
    return int(other[0]) if len(other) else m


class Lows:
    """Smallest of a block's lengths between any two places."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            row, half = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(row[:-half], row[half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the places from ``a`` to ``b``, both included."""
        level = np.log2(b - a + 1).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][a[at]], self.rows[k][b[at] - (1 << int(k)) + 1])
        return out


NEVER = 1 << 40


def _feed_bytes(blocks: Iterator[np.ndarray], queue: Queue, text, small, kind: int, cap: int, counted: bool, first: int) -> None:
    """Puts the suffix before each one of ``blocks`` into the queue, if it is of the kind, with the length it shares.

    ``low`` has for each symbol the smallest length since one was last put in for it; -1 if none was.
    """
    low = np.full(256, -1, np.int64)
    if first >= 0:
        low[first] = NEVER
    for tuples in blocks:
        block = np.frombuffer(tuples, np.int64)
        at = block >> BITS
        chosen = np.flatnonzero(at > 0)
        chosen = chosen[small[at[chosen] - 1] == kind]
        before = at[chosen] - 1
        symbols = text[before]
        if not counted:
            queue.push(symbols, before << BITS)
            continue
        lengths = block & CAP
        lows = Lows(lengths)
        order = np.argsort(symbols, kind="stable")
        chosen, before, symbols = chosen[order], before[order], symbols[order].astype(np.int64)
        head = np.r_[True, symbols[1:] != symbols[:-1]] if len(symbols) else np.zeros(0, bool)
        least = lows.between(np.where(head, 0, np.r_[0, chosen[:-1] + 1] if len(chosen) else chosen), chosen)
        earlier = low[symbols]
        least = np.where(head, np.where(earlier < 0, -1, np.minimum(least, earlier)), least)
        seen = low >= 0
        low[seen] = np.minimum(low[seen], lengths.min())
        last = np.flatnonzero(np.r_[head[1:], True]) if len(head) else np.zeros(0, np.int64)
        rest = np.full(len(last), NEVER, np.int64)
        more = chosen[last] + 1 < len(block)
        rest[more] = lows.between(chosen[last][more] + 1, np.full(more.sum(), len(block) - 1))
        low[symbols[last]] = rest
        queue.push(symbols, before << BITS | np.minimum(cap, least + 1))


def _feed_names(blocks: Iterator, queue: Queue, text, small, kind: int, cap: int, counted: bool, first: int) -> None:
    """As _feed_bytes, tuple by tuple; the stack (at, low) holds the steps with a length that no later one is below."""
    text, small = memoryview(text), memoryview(small)
    at, low, step, last = [0], [0], 0, {first: 0} if first >= 0 else {}
    for block in blocks:
        tails, pushed = queue.tails, 0
        for value in block:
            i = value >> BITS
            if counted:
                step += 1
                length = value & CAP
                while low and low[-1] >= length:
                    low.pop()
                    at.pop()
                at.append(step)
                low.append(length)
            if i and small[i - 1] == kind:
                i -= 1
                c = text[i]
                length = 0
                if counted:
                    since = last.get(c)
                    if since is not None:
                        length = min(cap, low[bisect_right(at, since)] + 1)
                    last[c] = step
                tail = tails.get(c)
                if tail is None:
                    tail = queue.open(c)
                tail.append(i << BITS | length)
                pushed += 1
        queue.settle(pushed)


def _same_names(text, a: int, b: int, n: int, cap: int) -> int:
    """As _same_run, symbol by symbol."""
    c, k = text[a], 1
    while k < cap and a + k < n and b + k < n and text[a + k] == c == text[b + k]:
        k += 1
    return k


def _rise_names(text, seeds, shared, queue: Queue, out: Row, cap: int) -> Iterator:
    """As _rise, for few suffixes a symbol."""
    n, k, m = len(text), 0, len(seeds)
    text, seeds, shared = memoryview(text), memoryview(seeds), None if shared is None else memoryview(shared)
    queue.open(text[n - 1]).append((n - 1) << BITS)
    queue.settle(1)
    while (symbol := queue.top()) is not None or k < m:
        if symbol is None or (k < m and text[seeds[k]] < symbol):
            symbol = text[seeds[k]]
        before, block = -1, []
        for tuples in queue.blocks(symbol):
            out.extend(tuples)
            before = tuples[-1] >> BITS
            yield tuples
        if k < m and text[seeds[k]] == symbol:
            block.append(seeds[k] << BITS | (_same_names(text, before, seeds[k], n, cap) if before >= 0 else 0))
            k += 1
            while k < m and text[seeds[k]] == symbol:
                block.append(seeds[k] << BITS | (shared[k] if shared else 0))
                k += 1
                if len(block) == BLOCK:
                    yield block
                    block = []
            yield block


def _fall_names(text, rising, queue: Queue, out: Row, cap: int) -> Iterator:
    """As _fall, for few suffixes a symbol."""
    n, k = len(text), len(rising) - 1
    text, rising = memoryview(text), memoryview(rising)
    while (symbol := queue.top()) is not None or k >= 0:
        if symbol is None or (k >= 0 and text[rising[k] >> BITS] > symbol):
            symbol = text[rising[k] >> BITS]
        before, block = -1, []
        for tuples in queue.blocks(symbol):
            out.extend(tuples)
            before = tuples[-1] >> BITS
            yield tuples
        length = -1
        while k >= 0 and text[rising[k] >> BITS] == symbol:
            value = rising[k]
            i = value >> BITS
            block.append(i << BITS | (length if length >= 0 else _same_names(text, before, i, n, cap) if before >= 0 else 0))
            length = value & CAP
            k -= 1
            if len(block) == BLOCK:
                yield block
                block = []
        yield block


def _merged_names(text, rising, falling, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _merged, for few suffixes a symbol."""
    n, k, f = len(text), 0, len(falling) - 1
    text, rising, falling = memoryview(text), memoryview(rising), memoryview(falling)
    at, lengths = array("q"), array("q")
    while k < len(rising) or f >= 0:
        symbol = min(text[rising[k] >> BITS] if k < len(rising) else NEVER, text[falling[f] >> BITS] if f >= 0 else NEVER)
        before = -1
        while k < len(rising) and text[rising[k] >> BITS] == symbol:
            at.append(rising[k] >> BITS)
            lengths.append(rising[k] & CAP if before >= 0 else 0)
            before = at[-1]
            k += 1
        length = -1
        while f >= 0 and text[falling[f] >> BITS] == symbol:
            at.append(falling[f] >> BITS)
            lengths.append(length if length >= 0 else _same_names(text, before, at[-1], n, cap) if before >= 0 else 0)
            length = falling[f] & CAP
            f -= 1
        if len(at) >= BLOCK:
            yield np.array(at, np.int64), np.array(lengths, np.int64)
            at, lengths = array("q"), array("q")
    yield np.array(at, np.int64), np.array(lengths, np.int64)


def _rise(text, seeds, shared, queue: Queue, out: Row, cap: int) -> Iterator[np.ndarray]:
    """Blocks of larger suffixes and seeds in rising order; the larger ones are kept in ``out``."""
    n, k, m = len(text), 0, len(seeds)
    queue.push(text[n - 1 :].astype(np.int64), np.array([(n - 1) << BITS]))
    while (symbol := queue.top()) is not None or k < m:
        if symbol is None or (k < m and text[seeds[k]] < symbol):
            symbol = int(text[seeds[k]])
        before = -1
        for block in queue.blocks(symbol):
            out.extend(block)
            before = block[-1] >> BITS
            yield block
        head = True
        while k < m and text[seeds[k]] == symbol:
            part = seeds[k : k + BLOCK]
            part = part[: np.searchsorted(text[part], symbol, "right")]
            lengths = np.zeros(len(part), np.int64) if shared is None else shared[k : k + len(part)].copy()
            if head:
                lengths[0] = _same_run(text, before, int(part[0]), cap) if before >= 0 else 0
                head = False
            k += len(part)
            yield part << BITS | lengths


def _fall(text, rising, queue: Queue, out: Row, cap: int) -> Iterator[np.ndarray]:
    """Blocks of smaller and larger suffixes in falling order; the smaller ones are kept in ``out``."""
    k = len(rising)
    while (symbol := queue.top()) is not None or k:
        if symbol is None or (k and text[rising[k - 1] >> BITS] > symbol):
            symbol = int(text[rising[k - 1] >> BITS])
        before = -1
        for block in queue.blocks(symbol):
            out.extend(block)
            before = block[-1] >> BITS
            yield block
        length = -1
        while k and text[rising[k - 1] >> BITS] == symbol:
            part = rising[max(0, k - BLOCK) : k]
            part = part[np.searchsorted(text[part >> BITS], symbol, "left") :][::-1]
            if length < 0:
                length = _same_run(text, before, int(part[0] >> BITS), cap) if before >= 0 else 0
            k -= len(part)
            yield (part >> BITS) << BITS | np.r_[length, part[:-1] & CAP]
            length = int(part[-1] & CAP)


def _induce(text, small, seeds, shared, cap: int, folder: Folder) -> tuple[np.ndarray, np.ndarray]:
    """Larger suffixes in rising order and smaller ones in falling order, as tuples of position and length shared with the one before.

    ``seeds`` are the leftmost smaller suffixes in order, at least by first symbol;
    ``shared`` their lengths shared with the seed before, or None if lengths are not asked for.
    """
    wide = text.dtype == np.uint8
    feed, rise, fall = (_feed_bytes, _rise, _fall) if wide else (_feed_names, _rise_names, _fall_names)
    larger, smaller, queue = Row(folder), Row(folder), Queue(folder, False)
    feed(rise(text, seeds, shared, queue, larger, cap), queue, text, small, 0, cap, shared is not None, int(text[-1]))
    rising, queue = larger.view(), Queue(folder, True)
    feed(fall(text, rising, queue, smaller, cap), queue, text, small, 1, cap, shared is not None, -1)
    return rising, smaller.view()


def _merged(text, rising, falling, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all suffixes in order with the length shared with the one before."""
    k, f = 0, len(falling)
    while k < len(rising) or f:
        symbol = min(int(text[rising[k] >> BITS]) if k < len(rising) else NEVER, int(text[falling[f - 1] >> BITS]) if f else NEVER)
        before, head = -1, True
        while k < len(rising) and text[rising[k] >> BITS] == symbol:
            part = rising[k : k + BLOCK]
            part = part[: np.searchsorted(text[part >> BITS], symbol, "right")]
            lengths = part & CAP
            if head:
                lengths[0], head = 0, False
            before = int(part[-1] >> BITS)
            k += len(part)
            yield part >> BITS, lengths
        length = -1
        while f and text[falling[f - 1] >> BITS] == symbol:
            part = falling[max(0, f - BLOCK) : f]
            # Falling from the largest symbol, so the wanted ones are at the end of the part.
            part = part[np.searchsorted(-text[part >> BITS].astype(np.int64), -symbol, "left") :][::-1]
            if length < 0:
                length = _same_run(text, before, int(part[0] >> BITS), cap) if before >= 0 else 0
            f -= len(part)
            yield part >> BITS, np.r_[length, part[:-1] & CAP]
            length = int(part[-1] & CAP)


def _matches(text, x: np.ndarray, y: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How far text at ``x`` and ``y`` agrees, known to do so up to ``start``, at most to ``stop``."""
    out = start.copy()
    open_ = np.flatnonzero(out < stop)
    while len(open_):
        same = text[x[open_] + out[open_]] == text[y[open_] + out[open_]]
        open_ = open_[same]
        out[open_] += 1
        open_ = open_[out[open_] < stop[open_]]
    return out


def _doubled(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of ``names`` in order and the lengths shared with the one before, up to ``cap``, in memory.

    A round orders suffixes that agree in as many names as the rounds before have compared by the rank of what follows.
    A suffix alone in its rank keeps its place, so a round costs by those that are left.
    """
    m, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    # Equal symbols have one rank, the place of the first; behind the end stands what is below all.
    rank, ranks = np.full(m + 1, -1, np.int64), []
    left, key = np.arange(m), names[order]
    while True:
        head = np.r_[True, key[1:] != key[:-1]]
        rank[order[left]] = left[np.maximum.accumulate(np.where(head, np.arange(len(left)), 0))]
        if reach <= cap:
            ranks.append(rank.astype(np.int32))
        left = left[~(head & np.r_[head[1:], True])]
        if not len(left):
            break
        at = order[left]
        key = rank[at] * (m + 1) + rank[np.minimum(at + reach, m)] + 1
        by_key = np.argsort(key)
        order[left], key = at[by_key], key[by_key]
        reach *= 2
    common = np.zeros(m, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = np.minimum(order[1:] + common[1:], m), np.minimum(order[:-1] + common[1:], m)
        common[1:] += (ranks[k][x] == ranks[k][y]).astype(np.int64) << k
    return order, np.minimum(common, cap)


def suffixes(text: np.ndarray, cap: int, folder: Folder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, lengths shared with the suffix before, up to ``cap``) of all suffixes of ``text`` in order.

    ``text`` is an array of bytes, or of names (64-bit integers from 0).
    """
    if cap > CAP:
        raise ValueError(f"lengths are kept up to {CAP}")
    n = len(text)
    if n == 0:
        return
    small = _types(text, folder)
    places = Row(folder)
    for a in range(1, n, BLOCK):
        places.extend(np.flatnonzero(small[a : a + BLOCK] & ~small[a - 1 : a - 1 + len(small[a : a + BLOCK])] & 1) + a)
    lms = places.view()
    m = len(lms)
    by_symbol, seeds = Queue(folder, False), Row(folder)
    if text.dtype == np.uint8:
        for a in range(0, m, BLOCK):
            by_symbol.push(text[lms[a : a + BLOCK]], lms[a : a + BLOCK])
    else:
        names, tails = memoryview(text), by_symbol.tails
        for a in range(0, m, BLOCK):
            tails = by_symbol.tails
            for i in lms[a : a + BLOCK].tolist():
                tail = tails.get(names[i])
                (by_symbol.open(names[i]) if tail is None else tail).append(i)
            by_symbol.settle(len(lms[a : a + BLOCK]))
    while (symbol := by_symbol.top()) is not None:
        for block in by_symbol.blocks(symbol):
            seeds.extend(block)
    _, falling = _induce(text, small, seeds.view(), None, cap, folder)
    # The seeds in the order of their substrings, and names in the order of the text.
    number, name_of = folder.zeros(n // 2 + 1, np.int64), folder.zeros(m, np.int64)
    number[lms >> 1] = np.arange(m)
    ends = np.r_[lms[1:] + 1, n] if m else lms
    ordered, name, last = Row(folder), -1, -1
    for b in range(len(falling), 0, -BLOCK):
        at = falling[max(0, b - BLOCK) : b][::-1] >> BITS
        at = at[(at > 0) & (small[np.maximum(at - 1, 0)] == 0)]
        if not len(at):
            continue
        ordered.extend(at)
        own = number[at >> 1]
        before = np.r_[last if last >= 0 else own[0], own[:-1]]
        length, other = ends[own] - lms[own], ends[before] - lms[before]
        equal = (length == other) & ((own == m - 1) == (before == m - 1))
        full = np.where(equal, length, 0)
        equal &= _matches(text, lms[own], lms[before], np.zeros(len(own), np.int64), full) == length
        if last < 0:
            equal[0] = False
        names = name + np.cumsum(~equal)
        name_of[own] = names
        name, last = int(names[-1]), int(own[-1])
    if name + 1 < m <= HELD // 2:
        order, common = _doubled(name_of, cap)
    elif name + 1 < m:
        deeper, shared_names = Row(folder), Row(folder)
        for at, lengths in suffixes(name_of, cap, folder):
            deeper.extend(at)
            shared_names.extend(lengths)
        order, common = deeper.view(), shared_names.view()
    else:
        order, common = number[ordered.view() >> 1], np.zeros(m, np.int64)
    shared = folder.zeros(m, np.int64)
    for a in range(1, m, BLOCK):
        x, y = order[a : a + BLOCK], order[a - 1 : a - 1 + len(order[a : a + BLOCK])]
        after = common[a : a + len(x)]

        def reach(k: np.ndarray, after=after) -> np.ndarray:
            far = k + after
            return np.where(far < m, lms[np.minimum(far, m - 1)] - lms[k], cap)

        known = np.minimum(np.minimum(reach(x), reach(y)), cap)
        stop = np.minimum(cap, n - np.maximum(lms[x], lms[y]))
        shared[a : a + len(x)] = _matches(text, lms[x], lms[y], np.minimum(known, stop), stop)
    rising, falling = _induce(text, small, lms[order], shared, cap, folder)
    yield from (_merged if text.dtype == np.uint8 else _merged_names)(text, rising, falling, cap)
