"""Approximate nearest neighbours by adaptive dimension scan over probed lists.

Vectors are dealt to lists by their nearest centroid and stored rotated by a random
orthogonal matrix, so that a partial distance over the first d columns, scaled by
dims / d, estimates the whole one.  A query probes its nearest lists.  In a list
candidates are compared column block by column block; after each block a
hypothesis test abandons those whose estimate is beyond the k-th distance so far by more than
its error allows.  What is left is compared exactly, in double precision, on
the original vectors.

Centroids come from a sample of at most SAMPLE distinct vectors, and so does the
number of probed lists: the smallest that finds TARGET of the neighbours of held-out
sample vectors.  Every vector is indexed.  Equal vectors are one entry with their k + 1
smallest ids: others can be in no result, since ties go to smaller ids.  Lists are
cut into chunks of bounded mean size and their queries into blocks, so a hot
list or vector spreads over tasks; partial results hold k rows a query.

Vectors that are NULL or zero, hold NULL or non-finite components, or have another
length than the most frequent one take no part, nor do rows with a NULL id.  Rows that
share an id are one candidate with the vector that sorts first.  Fewer than k
candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskline.operators.lineage import written

SAMPLE, HELD_OUT, TARGET = 20_000, 256, 0.97
MAX_LISTS, ROUNDS = 1024, 8
#: Columns of a block, and the error allowed for in the test, in units of 1 / sqrt(columns seen).
BLOCK, ERROR = 8, 2.1
#: Mean entries of a chunk of a list, and mean queries of a block.
CHUNK, QUERIES = 20_000, 20_000
SEED = 42


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.where(F.col(key).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    good = good.select(F.col(key).cast("bigint").alias("id"), v.cast("array<float>").alias("vec"))
    sizes = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vec") == (sizes["n"] if sizes else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def _nearest(a: np.ndarray, centroids: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([np.argmin(_squares(a[i : i + step], centroids), axis=1) for i in range(0, len(a), step)] or [np.zeros(0, int)])


class Lists:
    """Rotation, centroids and number of probed lists, from a sample (float32, one vector a row)."""

    def __init__(self, sample: np.ndarray, n: int, k: int):
        rng = np.random.default_rng(SEED)
        dims = sample.shape[1]
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        self.rotation = (q * np.sign(np.diag(r))).astype(np.float32)
        rotated = sample @ self.rotation
        size = max(1, min(MAX_LISTS, math.ceil(math.sqrt(n)), len(rotated)))
        centroids = rotated[rng.choice(len(rotated), size, replace=False)]
        for _ in range(ROUNDS):
            own = _nearest(rotated, centroids)
            sums = np.zeros_like(centroids)
            np.add.at(sums, own, rotated)
            counts = np.bincount(own, minlength=size)
            centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids).astype(np.float32)
        self.centroids = centroids
        self.probes = self._probes(rotated, _nearest(rotated, centroids), rng, k)

    def _probes(self, rotated: np.ndarray, own: np.ndarray, rng, k: int) -> int:
        """How many lists hold TARGET of the neighbours of held-out vectors of the sample."""
        held = rng.choice(len(rotated), min(HELD_OUT, len(rotated)), replace=False)
        k = min(k, len(rotated) - 1)
        if k < 1:
            return len(self.centroids)
        far = _squares(rotated[held], rotated)
        far[np.arange(len(held)), held] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        place = np.empty((len(held), len(self.centroids)), int)
        order = np.argsort(_squares(rotated[held], self.centroids), axis=1)
        np.put_along_axis(place, order, np.arange(len(self.centroids))[None, :], axis=1)
        return int(np.quantile(np.take_along_axis(place, own[near], axis=1), TARGET, method="higher")) + 1


#: Queries and entries compared at once, and the share of pairs left at which they are followed one by one.
AT_ONCE, STEP, SPARSE = 512, 4096, 0.25


def _scan(entries: np.ndarray, rotated: np.ndarray, asked: np.ndarray, turned: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, entry, distance) of the pairs that may be among the k nearest of a query, by adaptive dimension scan."""
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    bound = np.full(len(asked), np.inf)
    at = 0
    while at < len(entries):
        # The first few are compared whole: they set the bounds.
        stop = min(len(entries), at + (4 * k if at == 0 else STEP))
        found = [_survivors(rotated[at:stop], turned[q : q + AT_ONCE], bound[q : q + AT_ONCE]) for q in range(0, len(asked), AT_ONCE)]
        qi = np.concatenate([f[0] + i * AT_ONCE for i, f in enumerate(found)])
        ei = np.concatenate([f[1] for f in found]) + at
        far = np.empty(len(qi))
        for i in range(0, len(qi), 1 << 16):
            diff = entries[ei[i : i + (1 << 16)]].astype(np.float64) - asked[qi[i : i + (1 << 16)]]
            far[i : i + (1 << 16)] = np.sqrt((diff * diff).sum(axis=1))
        qi, ei, far = np.r_[kept[0], qi], np.r_[kept[1], ei], np.r_[kept[2], far]
        order = np.lexsort((far, qi))
        qi, ei, far = qi[order], ei[order], far[order]
        starts = np.searchsorted(qi, np.arange(len(asked) + 1))
        full = starts[1:] - starts[:-1] >= k
        bound[full] = far[starts[:-1][full] + k - 1]
        near = far <= bound[qi]
        kept = [qi[near], ei[near], far[near]]
        at = stop
    return tuple(kept)


def _survivors(rotated: np.ndarray, turned: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of queries and entries that no test abandons, column block by column block."""
    dims = rotated.shape[1]
    partial, pairs, value = np.zeros((len(turned), len(rotated)), np.float32), None, None
    for d in range(0, dims, BLOCK):
        e = min(d + BLOCK, dims)
        # At the last block the estimate is the distance, but for rounding.
        slack = (1 + ERROR / math.sqrt(e)) ** 2 if e < dims else 1.001
        limit = bound * bound * (e / dims) * slack
        if pairs is None:
            partial += _squares(turned[:, d:e], rotated[:, d:e])
            alive = partial <= limit[:, None]
            if e == dims or alive.mean() < SPARSE:
                pairs = np.nonzero(alive)
                value = partial[pairs]
        else:
            diff = turned[pairs[0], d:e] - rotated[pairs[1], d:e]
            value = value + (diff * diff).sum(axis=1)
            alive = value <= limit[pairs[0]]
            pairs, value = (pairs[0][alive], pairs[1][alive]), value[alive]
    return pairs


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, key, vector), "vectors")
    same = W.partitionBy("vec").orderBy("id")
    entries = written(
        rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "entries",
    )
    n = entries.count()
    empty = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    if not n:
        return empty
    # The share is cut by hash first, so that no task sends many more vectors than are taken.
    draw = F.pmod(F.xxhash64("vec"), F.lit(1 << 40))
    share = min(1.0, 1.1 * SAMPLE / n)
    some = entries.select("vec").where(draw < int(share * (1 << 40))).orderBy(draw, "vec").limit(SAMPLE).collect()
    lists = Lists(np.array([r["vec"] for r in some], np.float32), n, k)
    shared = spark.sparkContext.broadcast(lists)  # at most MAX_LISTS centroids and a square matrix of the dimensions

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rotated = np.array(b.column("vec").to_pylist(), np.float32).reshape(b.num_rows, -1) @ shared.value.rotation
            own = _nearest(rotated, shared.value.centroids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), *b.columns, pa.array([r.tobytes() for r in rotated], pa.binary())], ["list", "vec", "ids", "rotated"]
            )

    index = written(entries.select("vec", "ids").mapInArrow(assign, "list int, vec array<float>, ids array<long>, rotated binary"), "index")
    sizes = np.zeros(len(lists.centroids), int)
    for r in index.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    chunks = np.maximum(1, -(-sizes // CHUNK))
    asked = rows.where(F.col("id") % every == 0)
    queries = written(asked.groupBy("vec").agg(F.min("id").alias("qid")), "queries")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its nearest lists, and more of them where those hold fewer than k + 1 entries."""
        for b in batches:
            if not b.num_rows:
                continue
            rotated = np.array(b.column("vec").to_pylist(), np.float32).reshape(b.num_rows, -1) @ shared.value.rotation
            order = np.argsort(_squares(rotated, shared.value.centroids), axis=1, kind="stable")
            enough = np.argmax(np.cumsum(sizes[order], axis=1) >= min(n, k + 1), axis=1) + 1
            chosen = [o[: max(e, shared.value.probes)] for o, e in zip(order, enough, strict=True)]
            for i in range(0, b.num_rows, 64):
                part = range(i, min(i + 64, b.num_rows))
                at = np.concatenate([np.full(len(chosen[j]), j) for j in part])
                yield pa.RecordBatch.from_arrays(
                    [b.column("qid").take(pa.array(at)), b.column("vec").take(pa.array(at)), pa.array(np.concatenate([chosen[j] for j in part]).astype(np.int32))],
                    ["qid", "qvec", "list"],
                )

    probed = written(queries.select("qid", "vec").mapInArrow(probe, "qid long, qvec array<float>, list int"), "probes")
    blocks = np.ones(len(sizes), int)
    for r in probed.groupBy("list").count().collect():
        blocks[r["list"]] = -(-r["count"] // QUERIES)
    n_chunks, n_blocks = (F.get(F.array(*[F.lit(int(x)) for x in a]), F.col("list")) for a in (chunks, blocks))
    left = index.withColumn("chunk", F.pmod(F.xxhash64("vec"), n_chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    right = probed.withColumn("block", F.pmod(F.xxhash64("qid"), n_blocks).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))

    def match(chunk: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        qid, vid, score = [], [], []
        if len(chunk) and len(block):
            vec = np.array(chunk["vec"].tolist(), np.float32)
            rotated = np.frombuffer(b"".join(chunk["rotated"]), np.float32).reshape(len(chunk), -1)
            ids = chunk["ids"].tolist()
            asked = np.array(block["qvec"].tolist(), np.float32)
            turned = asked @ shared.value.rotation
            own, names = [[] for _ in asked], block["qid"].tolist()
            for q, e, far in zip(*(x.tolist() for x in _scan(vec, rotated, asked.astype(np.float64), turned, k + 1)), strict=True):
                own[q] += [(far, i) for i in ids[e]]
            for q, near in zip(names, own, strict=True):
                near = sorted(near)[: k + 1]
                qid += [q] * len(near)
                vid += [i for _, i in near]
                score += [f for f, _ in near]
        return pd.DataFrame({"qid": np.array(qid, np.int64), "id": np.array(vid, np.int64), "score": np.array(score, np.float64)})

    keys = ["list", "chunk", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(match, "qid long, id long, score double")
    per_vector = W.partitionBy("qid").orderBy("score", "id")
    best = parts.withColumn("r", F.row_number().over(per_vector)).where(F.col("r") <= k + 1).drop("r")
    named = asked.select(F.col("id").alias("query_id"), "vec").join(queries, "vec").select("query_id", "qid")
    per_query = W.partitionBy("query_id").orderBy("score", "id")
    found = named.join(best, "qid").where("id <> query_id").withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")
