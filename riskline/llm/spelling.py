"""Spelling variants of the words of a corpus, found in a trie of letter-group counts.

Letters are dealt into groups, and a word's vector holds how many letters of each group it has.
The trie branches on the count of one group after the other.  One inserted, deleted or
replaced letter adds at most one to one count and takes at most one from another, so
words near a given one are found depth first from the root: each step follows the branch of
the word's own count, that of one more while a surplus of one is left, and, once that has been
spent, that of one less while a deficit of one is left.  The words at the leaves that are reached
are verified.  A pair whose vectors differ is met from one side only (the shorter word, or the
one that lacks a letter of the earlier group) and counts for both.

The upper ``depth`` counts of a vector name the cell that a word is kept in; a search enters the
cells that its budget reaches and goes on in each from what is left of it.  A cell with more than
``CELL`` words or searches is dealt by hash into blocks of words times blocks of searches,
so no task holds more, and each search still meets every word of the cell once.
In a task a batch of searches goes down the trie together, as arrays.  What leaves it is the
number and the best of the near words of each search, not pairs.

Words are counted in the tasks that read the texts, with partial counts sent on whenever
``HELD`` runs have come together.  Chains of forms are followed by doubling; counts grow at least
fivefold with each step, so they have no cycles and a few rounds reach their end.

Results for odd input: a NULL text has no words; a NULL doc_id counts as an empty text in front of
the colon.  Repeated rows count each time.  Other columns do not matter.  Tables without words
give an empty result.  Words may be of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.operators.lineage import written

#: Letters of one count; those not named here share the last.  Frequent letters stand alone (fixed values).
GROUPS = ("e", "a", "i", "o", "t", "n", "s", "r", "lu", "cd", "hm", "bgp", "fvy", "jkqwxz", "")
#: Runs that a task holds, words and searches that meet in one block, searches of one batch, pairs verified at once.
HELD, CELL, BATCH, PAIRS = 3_000_000, 60_000, 20_000, 400_000
#: Words a cell should have, and the share of them that a further count leaves in a cell.
FULL, SPREAD = 150_000, 2.2
#: Letters of the words that are verified as arrays; longer ones are verified one by one.
WIDE = 40


def runs_of() -> bytes:
    """For each byte of Latin-1 the letter of a run, A-Z in lower case, or a space."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def variants(docs: DataFrame, shortest: int, one_in: int) -> DataFrame:
    """(word, n) partial counts of the runs of at least ``shortest`` letters, one in ``one_in`` (document, run) with a letter less."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = runs_of()
        held: list[pa.Array] = []
        found: list[bytes] = []

        def sent() -> pa.RecordBatch:
            counts = pa.chunked_array([*held, pa.array(found, pa.binary())]).value_counts()
            held.clear()
            found.clear()
            made = pa.array([w.decode("latin-1") for w in counts.field("values").to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([made, counts.field("counts")], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (text := text.as_py()):
                    continue
                start = zlib.crc32(f"{doc or ''}:".encode())
                # A code point of a run is one byte of Latin-1; others become a mark that is no letter.
                runs = [w for w in text.encode("latin-1", "replace").translate(letters).split(b" ") if len(w) >= shortest]
                hashes = [zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start) for w in runs]
                for i, h in enumerate(hashes):
                    if h % one_in == 0:
                        w = runs[i]
                        runs[i] = w[: h % len(w)] + w[h % len(w) + 1 :]
                found += runs
                if len(found) >= HELD // 30:
                    held.append(pa.array(found, pa.binary()))
                    found.clear()
                    if len(held) >= 30:
                        yield sent()
        if held or found:
            yield sent()

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")


def words(docs: DataFrame, shortest: int = 6, least: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): the words of at least ``shortest`` letters with ``least`` occurrences."""
    found = variants(docs, shortest, one_in).where(F.length("word") >= shortest)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def group_of() -> np.ndarray:
    """The group of each code point below 256."""
    table = np.full(256, len(GROUPS) - 1, np.uint8)
    for k, letters in enumerate(GROUPS):
        for c in letters:
            table[ord(c)] = k
    return table


def vectors(found: list[str]) -> np.ndarray:
    """The letter-group counts of words, a row each."""
    letters = group_of()[np.frombuffer("".join(found).encode("latin-1"), np.uint8)].astype(np.int64)
    owner = np.repeat(np.arange(len(found)), [len(w) for w in found])
    return np.bincount(owner * len(GROUPS) + letters, minlength=len(found) * len(GROUPS)).reshape(-1, len(GROUPS))


class Trie:
    """The words of a block by the counts of their vectors, one level a count."""

    def __init__(self, found: list[str], counts: np.ndarray):
        order = np.lexsort(counts.T[::-1])
        self.words, counts = [found[i] for i in order], counts[order]
        self.width = int(counts.max(initial=0)) + 3
        self.branches: list[np.ndarray] = []
        node = np.zeros(len(order), np.int64)
        for k in range(counts.shape[1]):
            # A branch is its node and count; the words stand in the order of the branches, which number the nodes below.
            at = node * self.width + counts[:, k]
            firsts = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            self.branches.append(at[firsts])
            node = np.cumsum(firsts) - 1
        self.starts = np.searchsorted(node, np.arange(len(self.branches[-1]) + 1)) if self.branches else np.array([0, len(order)])

    def down(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The nodes below by the branches of the given counts, -1 where there is none."""
        branches, wanted = self.branches[level], node * self.width + count
        if not len(branches):
            return np.full(len(node), -1)
        at = np.minimum(np.searchsorted(branches, wanted), len(branches) - 1)
        return np.where((count >= 0) & (count < self.width) & (branches[at] == wanted), at, -1)

    def search(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(searches, leaves, whether the vectors differ) that the budgets reach, depth first in batches.

        ``counts`` are those of the searches.  A deficit is spent below a surplus only.
        """
        stack = [
            (0, at, np.zeros(len(at), np.int64), surplus[at], deficit[at])
            for at in (np.arange(i, min(i + BATCH, len(counts))) for i in range(0, len(counts), BATCH))
        ]
        while stack:
            level, at, node, more, less = stack.pop()
            if level == len(self.branches):
                yield at, node, more == 0
                continue
            own = counts[at, level]
            for step in (0, 1, -1):
                may = np.arange(len(at)) if not step else np.flatnonzero(more > 0 if step > 0 else (more == 0) & (less > 0))
                if not len(may):
                    continue
                below = self.down(level, node[may], own[may] + step)
                may, below = may[below >= 0], below[below >= 0]
                if len(may):
                    stack.append((level + 1, at[may], below, more[may] - (step > 0), less[may] - (step < 0)))


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # the length of the common start
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


class Letters:
    """Words as rows of letters, from the left and from the right; those over WIDE letters stay words only."""

    def __init__(self, found: list[str]):
        self.words, self.size = found, np.array([len(w) for w in found], np.int64)
        short = np.flatnonzero(self.size <= WIDE)
        owner = np.repeat(short, self.size[short])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(self.size[short]) - self.size[short], self.size[short])
        letters = np.frombuffer("".join(found[i] for i in short).encode("latin-1"), np.uint8)
        self.left, self.right = (np.zeros((len(found), int(self.size[short].max(initial=0))), np.uint8) for _ in range(2))
        self.left[owner, at] = letters
        self.right[owner, self.size[owner] - 1 - at] = letters


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common start of the rows of two tables of letters."""
    wide = min(a.shape[1], b.shape[1])
    other = np.ones((len(a), wide + 1), bool)
    np.not_equal(a[:, :wide], b[:, :wide], out=other[:, :wide])
    return other.argmax(axis=1)


def near_rows(ours: Letters, theirs: Letters, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether the pairs (q, w) are near: what starts and ends alike leaves out at most one letter of the longer word."""
    a, b = ours.size[q], theirs.size[w]
    good = np.abs(a - b) <= 1
    long = np.flatnonzero(good & (np.maximum(a, b) > WIDE))
    at = np.flatnonzero(good & (np.maximum(a, b) <= WIDE))
    start = _common(ours.left[q[at]], theirs.left[w[at]])
    end = _common(ours.right[q[at]], theirs.right[w[at]])
    longer, shorter = np.maximum(a[at], b[at]), np.minimum(a[at], b[at])
    alike = np.minimum(start, shorter) + np.minimum(end, shorter)
    good[:] = False
    good[at] = (alike >= longer - 1) & ~((a[at] == b[at]) & (start >= longer))
    good[long] = [near(ours.words[i], theirs.words[j]) for i, j in zip(q[long].tolist(), w[long].tolist(), strict=True)]
    return good


def near_words(kept: pa.Table, sought: pa.Table, depth: int) -> pa.Table:
    """(word, n_near, best_n, best) of the words that have near ones in a block of a cell, as far as met there.

    ``kept`` (word, n) agree in their first ``depth`` counts; ``sought`` (asked, n, more, less) have
    come to them with that surplus and deficit left.
    """
    found, asked = kept["word"].to_pylist(), sought["asked"].to_pylist()
    trie = Trie(found, vectors(found)[:, depth:])
    number = dict(zip(found, kept["n"].to_pylist(), strict=True))
    n, asked_n = np.array([number[w] for w in trie.words], np.int64), sought["n"].to_numpy().astype(np.int64)
    ours, theirs = Letters(asked), Letters(trie.words)
    # Searches with the same budget go down together.
    budget = np.column_stack([sought[c].to_numpy().astype(np.int64) for c in ("more", "less")]).reshape(-1, 2)
    order = np.lexsort(budget.T)
    counts, budget = vectors(asked)[:, depth:][order], budget[order]
    hits: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    for searches, leaves, differ in trie.search(counts, budget[:, 0], budget[:, 1]):
        first, sizes = trie.starts[leaves], trie.starts[leaves + 1] - trie.starts[leaves]
        ends = np.cumsum(sizes)
        for low in range(0, int(ends[-1]), PAIRS):
            pair = np.arange(low, min(low + PAIRS, int(ends[-1])))
            at = np.searchsorted(ends, pair, side="right")
            q, w = order[searches[at]], first[at] + pair - (ends[at] - sizes[at])
            good = near_rows(ours, theirs, q, w)
            hits.append(np.column_stack([q, w, differ[at]])[good])
    q, w, differ = np.concatenate(hits).T
    back = differ == 1
    parts = [_best(asked, q, trie.words, n, w), _best(trie.words, w[back], asked, asked_n, q[back])]
    return pa.concat_tables(parts)


def _best(owners: list[str], at: np.ndarray, others: list[str], n: np.ndarray, near_at: np.ndarray) -> pa.Table:
    """The number of near words of each owner, and the one of the largest count (ties: first in code-point order)."""
    seen = np.unique(near_at)
    place = np.zeros(len(others), np.int64)
    place[sorted(seen.tolist(), key=others.__getitem__)] = np.arange(len(seen))
    by = np.lexsort((place[near_at], -n[near_at], at))
    at, near_at = at[by], near_at[by]
    firsts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])[: len(at)]
    return pa.table(
        {
            "word": pa.array([owners[i] for i in at[firsts]], pa.string()),
            "n_near": pa.array(np.diff(np.r_[firsts, len(at)]), pa.int64()),
            "best_n": pa.array(n[near_at[firsts]], pa.int64()),
            "best": pa.array([others[i] for i in near_at[firsts]], pa.string()),
        }
    )


def _depth(n: int) -> int:
    """Upper counts that leave about FULL words a cell."""
    depth = 1
    while depth < len(GROUPS) - 1 and n > FULL * SPREAD**depth:
        depth += 1
    return depth


def _upper(word: Column, depth: int) -> Column:
    """The first counts of a word's vector."""
    return F.array(*[F.length(word) - F.length(F.translate(word, letters, "")) for letters in GROUPS[:depth]])


def _steps(depth: int) -> list[tuple[tuple[int, ...], int, int]]:
    """What a search may add to the first counts, with the surplus and the deficit that stay."""

    def at(**moved: int) -> tuple[int, ...]:
        return tuple(moved.get(f"k{k}", 0) for k in range(depth))

    out = [(at(), 1, 1)] + [(at(**{f"k{k}": 1}), 0, 1) for k in range(depth)]
    return out + [(at(**{f"k{i}": 1, f"k{j}": -1}), 0, 0) for i, j in combinations(range(depth), 2)]


def with_near(table: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) of the words of ``table`` (word, n), a written table of distinct words."""
    depth = _depth(table.count())
    name = lambda counts: F.array_join(counts, ",")
    kept = table.select("word", "n", name(_upper(F.col("word"), depth)).alias("cell"))
    ways = F.array(
        *[F.struct(F.array(*map(F.lit, s)).alias("s"), F.lit(more).alias("more"), F.lit(less).alias("less")) for s, more, less in _steps(depth)]
    )
    sought = table.select(F.col("word").alias("asked"), F.col("n").alias("asked_n"), _upper(F.col("word"), depth).alias("own"), F.explode(ways).alias("way")).select(
        "asked", "asked_n", F.zip_with("own", "way.s", lambda a, b: a + b).alias("upper"), "way.more", "way.less"
    )
    sought = sought.where(F.array_min("upper") >= 0).select("asked", F.col("asked_n").alias("n"), name(F.col("upper")).alias("cell"), "more", "less")
    # Cells without words end here; the others are dealt into blocks if they are large.
    held = kept.groupBy("cell").agg(F.count("*").alias("m"))
    load = written(held.join(sought.groupBy("cell").agg(F.count("*").alias("q")), "cell"), "cells")
    parts = load.select("cell", F.ceil(F.col("m") / CELL).cast("int").alias("rows"), F.ceil(F.col("q") / CELL).cast("int").alias("columns"))
    drawn = lambda word, among: F.pmod(F.xxhash64(word), F.col(among)).cast("int")
    every = lambda among: F.explode(F.sequence(F.lit(0), F.col(among) - 1))
    kept = kept.join(parts, "cell").select("word", "n", "cell", drawn("word", "rows").alias("row"), every("columns").alias("column"))
    sought = sought.join(parts, "cell").select("asked", "n", "more", "less", "cell", every("rows").alias("row"), drawn("asked", "columns").alias("column"))
    block = ("cell", "row", "column")

    found = kept.groupBy(*block).cogroup(sought.groupBy(*block)).applyInArrow(lambda a, b: near_words(a, b, depth), "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    each = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return table.join(each, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("first.minus")).alias("best_n"), F.col("first.best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words of ``forms`` (word, form): the end of the chain that begins with their form.

    Each round doubles the steps that have been taken.  A form has few words (those one letter
    away), and only their number reaches the driver.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not now.join(on, "root", "left_semi").count():
            return now
        now = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "chains")


def grouped(docs: DataFrame, shortest: int = 6, least: int = 5, one_in: int = 199, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    A word's form is its near word of the largest count (ties: first in code-point order),
    if that has ``times`` its own count.
    """
    table = written(words(docs, shortest, least, one_in), "words")
    judged = with_near(table)
    chosen = F.col("best_n") >= times * F.col("n")
    judged = judged.select(
        "word", F.when(chosen, F.col("best")).alias("form"), "n", "n_near", F.when(chosen, F.col("best_n")).alias("form_n")
    )
    judged = written(judged, "judged")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
