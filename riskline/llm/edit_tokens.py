"""Token counts that follow edits.

The pre-tokens of a document are cut into leaves of LEAF; a segment tree over the
leaves holds the tokens of every subtree, and each leaf its length in code points.
An edit touches a few leaves.  Encoding starts anew at the last leaf whose start lies
LOOKAHEAD characters before the edit, since no pre-token that ends there can see
further, and stops at the first later leaf that begins where a new pre-token
does: from there on nothing can differ, as the pattern never looks back.  The
leaves between get the new pre-tokens, and the sums on their paths to the root are
updated.  Counts always equal those of encoding the edited text as a whole.

An edit replaces the code points from ``start`` to before ``stop`` of the text before
any edit.  Edits of a document are applied in order of start; those that overlap
an earlier one, lie beyond the text or hold NULLs are ignored and counted as such.
NULL text counts as empty.  Repeated rows are counted each, and edits of a doc_id go
to every row that has it.  An empty table stays empty; added columns replace columns
of the same name, all others pass unchanged.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.llm.rowwise import with_columns_of
from riskline.llm.text import fresh

#: Pre-tokens of a leaf, and how many times as many make the tree be built anew.
LEAF, CROWDED = 64, 8
#: Characters after its end that can decide where a pre-token ends (the pattern tests up to two after a quote).
LOOKAHEAD = 2
#: Pre-tokens whose counts a worker remembers: bounds its memory, not the result.
CACHED = 500_000

EDIT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("text", T.StringType())]))
TREE = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("leaf_chars", T.ArrayType(T.IntegerType())),
    T.StructField("sums", T.ArrayType(T.IntegerType())),
]


class Counter:
    """Pre-tokens of a text and their numbers of tokens."""

    def __init__(self, ranks: str, pattern: str):
        mergeable = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=mergeable, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        found = list(map(self.known.get, pieces))
        return [self.count(p) if n is None else n for n, p in zip(found, pieces, strict=True)] if None in found else found


@dataclass
class Tree:
    """Leaf lengths in code points, and token sums in heap order: the root is sums[1], leaf i sums[width + i]."""

    chars: list[int] = field(default_factory=list)
    sums: list[int] = field(default_factory=list)

    @property
    def tokens(self) -> int:
        return self.sums[1] if len(self.sums) > 1 else 0

    @property
    def width(self) -> int:
        return len(self.sums) // 2

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Sets a leaf and adds the change to the subtrees that hold it."""
        self.chars[leaf] = chars
        node = self.width + leaf
        change = tokens - self.sums[node]
        while node and change:
            self.sums[node] += change
            node //= 2


def build(counter: Counter, text: str) -> Tree:
    pieces = counter.pattern.findall(text)
    if not pieces:
        return Tree()
    starts = np.arange(0, len(pieces), LEAF)
    tokens = np.add.reduceat(np.array(counter.counts(pieces), np.int64), starts)
    chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), starts)
    width = 1 << (len(starts) - 1).bit_length()
    levels = [np.concatenate([tokens, np.zeros(width - len(tokens), np.int64)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    return Tree(chars.tolist(), [0, *np.concatenate(levels[::-1]).tolist()])


def usable(edits: list, size: int) -> list[tuple[int, int, str]]:
    """The edits that are applied, in order; of those that overlap the one that starts first."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(((e["start"], e["stop"], e["text"]) for e in edits or [] if e and None not in (e["start"], e["stop"], e["text"]))):
        if (out[-1][1] if out else 0) <= e[0] <= e[1] <= size:
            out.append(e)
    return out


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, stop, new in edits:
        parts += [text[at:start], new]
        at = stop
    return "".join([*parts, text[at:]])


def recount(counter: Counter, tree: Tree, text: str, edits: list[tuple[int, int, str]]) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many pre-tokens were encoded for it."""
    after = edited(text, edits)
    if not edits:
        return after, tree, 0
    if not tree.chars:
        fresh_tree = build(counter, after)
        return after, fresh_tree, len(counter.pattern.findall(after))
    tree = Tree(list(tree.chars), list(tree.sums))
    starts = np.concatenate([[0], np.cumsum(tree.chars)]).tolist()
    n_leaves, encoded, k, shift = len(tree.chars), 0, 0, 0
    crowded = False
    while k < len(edits):
        first = max(0, min(bisect_right(starts, edits[k][0] - LOOKAHEAD) - 1, n_leaves - 1))
        begin = starts[first] + shift
        pieces: list[str] = []
        leaf, end = first, len(after)
        for m in counter.pattern.finditer(after, begin):
            at = m.start()
            # Take in every edit up to here, then look for a leaf that begins at this pre-token.
            while k < len(edits) and at > edits[k][0] + shift:
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
            while leaf < n_leaves and starts[leaf] + shift < at:
                leaf += 1
            settled = pieces and leaf < n_leaves and starts[leaf] + shift == at and starts[leaf] >= edits[k - 1][1] if k else False
            if settled and leaf > first and (k == len(edits) or edits[k][0] >= starts[leaf] + LOOKAHEAD):
                end = at
                break
            pieces.append(m.group())
        else:
            while k < len(edits):
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
            leaf = n_leaves
        assert begin + sum(map(len, pieces)) == end
        counts = counter.counts(pieces)
        encoded += len(pieces)
        places = leaf - first
        crowded |= len(pieces) > CROWDED * LEAF * places
        for i in range(places):
            a, b = len(pieces) * i // places, len(pieces) * (i + 1) // places
            tree.put(first + i, sum(map(len, pieces[a:b])), sum(counts[a:b]))
    return after, build(counter, after) if crowded else tree, encoded


_COUNTERS: dict[int, Counter] = {}


def _counter(spec: tuple[str, str]) -> Counter:
    key = hash(spec)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(*spec)
    return _COUNTERS[key]


def _shared(docs: DataFrame, path: str, pattern: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast((f.read(), pattern))


def with_trees(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the token count and the segment tree of every text (vocabulary: tiktoken ranks at ``path``)."""
    spec = _shared(docs, path, pattern)

    def start():
        counter = _counter(spec.value)

        def one(t: str) -> tuple:
            tree = build(counter, t)
            return tree.tokens, tree.chars, tree.sums

        return one

    return with_columns_of(docs, text, TREE, start)


def attach(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the edits (doc_id, start, stop, text) of each document as a column ``edits``."""
    key, one = fresh(docs.columns, "_key"), F.struct("start", "stop", "text")
    per_doc = edits.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(one).alias("edits"))
    kept = [c for c in docs.columns if c.lower() != "edits"]
    return docs.select(*kept).join(per_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(key)), "left").drop(key)


def apply_edits(state: DataFrame, path: str, pattern: str) -> DataFrame:
    """``state`` (texts with trees and ``edits``) after its edits: text, tree and counts, with ``n_before``, ``n_edits`` and ``n_encoded``."""
    spec = _shared(state, path, pattern)
    fields = [
        T.StructField("text", T.StringType()), *TREE,
        T.StructField("n_before", T.LongType()), T.StructField("n_edits", T.LongType()), T.StructField("n_encoded", T.LongType()),
    ]
    packed = fresh(state.columns, "_state")
    made = state.withColumn(packed, F.struct("text", "leaf_chars", "sums", "edits"))

    def start():
        counter = _counter(spec.value)

        def one(row) -> tuple:
            text = row["text"] or ""
            tree = Tree(row["leaf_chars"] or [], row["sums"] or [])
            edits = usable(row["edits"], len(text))
            after, new, encoded = recount(counter, tree, text, edits)
            return after, new.tokens, new.chars, new.sums, tree.tokens, len(edits), encoded

        return one

    return with_columns_of(made, packed, fields, start).drop(packed, "edits")


# Fixed patterns of the edits that the registered query applies: personal data become a mask.
MASKS = [
    (regex.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "[email]"),
    (regex.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), "[address]"),
    (regex.compile(r"\+?\d[\d() -]{8,}\d"), "[number]"),
]


def with_masks(docs: DataFrame) -> DataFrame:
    """``docs`` with the edits that mask e-mail and network addresses and long numbers."""

    def masks(text: str) -> tuple[list]:
        found = [{"start": m.start(), "stop": m.end(), "text": new} for p, new in MASKS for m in p.finditer(text)]
        return (sorted(found, key=lambda e: (e["start"], e["stop"])),)

    return with_columns_of(docs, "text", [T.StructField("edits", EDIT)], lambda: masks)
