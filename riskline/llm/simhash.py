"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set where over half of its shingles' hashes
have it.  Two fingerprints differ in at most ``2 r`` bits exactly if some word is
within ``r`` bits of both; so every fingerprint stands for all its variants within
half the radius, and fingerprints that share a variant collide.

Equal fingerprints are one before anything is sent.  The shuffle key is the
variant's leading bits: a fingerprint goes once to every key that one of its
variants begins with, and the task of that key makes those variants, so what is
shuffled is a few dozen short rows for each fingerprint instead of thousands.
In a task variants are sorted in slices of bounded size, however many
fingerprints a key has; each collision is verified by its bit distance and
joins the two in a local forest, so a group of near copies gives as many links as
it has members, not pairs.  Links are distinct over keys, and components come from
repeated joins of the links with the smallest label around each fingerprint.

NULL text counts as empty; a text without words has the fingerprint zero, linked
like any other.  Component ids are the smallest doc_id that is not NULL; NULL if
there is none.  Repeated rows and ids share a fingerprint and hence a component.
An empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.llm.rowwise import with_columns_of
from riskline.llm.text import fresh
from riskline.operators.lineage import written

BITS = 64
SEED = 42
#: Variants sorted at once in a task, and the mean number that one shuffle key stands for.
SLICE, PER_KEY = 2_000_000, 400_000
HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of a text: A-Z lower-cased, words split at white space, ``shingle`` words at a time."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), HASHES):
        part = hashes[i : i + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int, name: str = "fp", text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer."""

    def signed(t: str) -> tuple[int]:
        fp = fingerprint(t, shingle)
        return (fp - (1 << BITS) if fp >> (BITS - 1) else fp,)

    return with_columns_of(docs, text, [T.StructField(name, T.LongType())], lambda: signed)


def _flips(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _key_bits(n: int, radius: int) -> int:
    """Leading bits that make about PER_KEY variants a key."""
    variants = n * sum(math.comb(BITS, r) for r in range(radius + 1))
    return min(24, max(0, math.ceil(math.log2(max(1, variants) / PER_KEY))))


def links(fps: DataFrame, n: int, radius: int) -> DataFrame:
    """Links (a, b) that connect any two of the distinct fingerprints ``fps`` (n of them) up to ``radius`` bits apart.

    Every link is between fingerprints at most ``radius`` bits apart; members of one
    local group are linked in a chain of such links.
    """
    half = (radius + 1) // 2
    lead = _key_bits(n, half)
    heads = F.array(*[F.lit(f) for f in _flips(lead, half)])
    top = F.shiftrightunsigned("fp", BITS - lead).cast("int") if lead else F.lit(0)
    sent = fps.select(F.explode(F.transform(heads, lambda f: f.bitwiseXOR(top))).alias("key"), "fp")

    def collide(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_collide(pdf["fp"].to_numpy(np.int64).view(np.uint64), int(pdf["key"].iloc[0]), lead, half, radius), columns=["a", "b"])

    return sent.groupBy("key").applyInPandas(collide, "a long, b long").distinct()


def _collide(fps: np.ndarray, key: int, lead: int, half: int, radius: int) -> np.ndarray:
    """A forest of links over the fingerprints of a key that share one of its variants."""
    fps = np.unique(fps)
    tail = BITS - lead
    spent = np.zeros(len(fps), np.int64)
    if lead:
        off = (fps >> np.uint64(tail)) ^ np.uint64(key)
        for b in range(lead):
            spent += ((off >> np.uint64(b)) & np.uint64(1)).astype(np.int64)
    low = fps & np.uint64((1 << tail) - 1) if lead else fps
    flips = [np.array(_flips(tail, r), np.uint64) for r in range(half + 1)]
    made = int(sum((spent == s).sum() * len(flips[half - s]) for s in range(half + 1)))
    # Beyond a slice, the variants are made part by part, by their next leading bits.
    cut = max(0, math.ceil(math.log2(made / SLICE))) if made > SLICE else 0
    parent = np.arange(len(fps))
    edges: list[np.ndarray] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for part in range(1 << cut):
        words, owners = [], []
        for s in range(half + 1):
            mine = np.flatnonzero(spent == s)
            for i in range(0, len(mine), 4096):
                some = mine[i : i + 4096]
                v = low[some][:, None] ^ flips[half - s][None, :]
                if cut:
                    at = np.nonzero((v >> np.uint64(tail - cut)) == np.uint64(part))
                    words.append(v[at])
                    owners.append(some[at[0]])
                else:
                    words.append(v.ravel())
                    owners.append(np.repeat(some, v.shape[1]))
        if not words:
            continue
        v, owner = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, owner = v[order], owner[order]
        at = np.flatnonzero(v[1:] == v[:-1])
        x, y = owner[at], owner[at + 1]
        pairs = np.unique(np.minimum(x, y) * len(fps) + np.maximum(x, y))
        x, y = pairs // len(fps), pairs % len(fps)
        near = np.bitwise_count(fps[x] ^ fps[y]) <= radius
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append(fps[[i, j]])
    return np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b); label is the smallest node of the component.

    Alternating rounds hang every neighbour of a node on the smallest one around
    it, first the larger neighbours, then the smaller, until all edges are stars.
    Each round is two aggregates and joins, and is written; the driver sees
    a count only.
    """
    current = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def hang(both: DataFrame, larger: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        on = both.join(least, "u")
        if larger:
            return on.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        kept = on.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return kept.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    before: tuple | None = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = hang(both, larger=True)
        current = written(hang(stars, larger=False), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def classes(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, label): the component of every fingerprint in ``marked``, named by its smallest fingerprint."""
    fps = written(marked.select("fp").distinct(), "fingerprints")
    found = components(links(fps, fps.count(), radius))
    return fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` without its text, with ``fp`` and ``component_id``."""
    new = ("fp", "component_id")
    names = [c for c in docs.columns if c != "text" and c.lower() not in new]
    marked = written(with_fingerprints(docs.select(*names, "text"), shingle).drop("text"), "marked")
    label = written(classes(marked, radius), "classes")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = label.join(least, "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    return marked.join(label.join(ids, "label").select("fp", "component_id"), "fp").select(*names, "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest doc_id (NULL last, ties by row)."""
    row, mark = fresh(docs.columns, "_row"), fresh(docs.columns, "fp")
    held = written(with_fingerprints(docs, shingle, mark).withColumn(row, F.monotonically_increasing_id()), "held")
    slim = held.select(F.col("doc_id"), F.col(row).alias("row"), F.col(mark).alias("fp"))
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row").alias("row"))
    per_fp = slim.groupBy("fp").agg(F.min(first).alias("first"))
    label = classes(slim, radius)
    stays = per_fp.join(label, "fp").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return held.join(stays.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
