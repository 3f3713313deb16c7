"""Removal of repeated byte strings of a fixed length, decided by externally sorted suffixes.

A byte goes if a string of ``window`` bytes that covers it also starts earlier (in a
smaller doc_id, or earlier in the document).  All strings are judged on the input.

1. Candidate search.  The windows of a text are cut into runs with one smallest
   hash of their inner grams.  It depends on the window alone, so equal windows
   are in runs with the same hash, and a hash that occurs once needs no look.
2. Equal runs are brought together by the hash of their bytes, first in each
   batch and then by a shuffle.  All but the first copy of a run start later than
   it; the first copies stand for all of them in the sort.  Which runs a batch
   leaves out depends on how rows are batched, so the runs are found once, go through
   one shuffle, and only what is left of them is written.
3. First copies that may hold a window of another run (the same hash, and the same bytes on
   one side of it) or equal windows themselves go to shards by the hash.
   A task writes the runs of a shard to a file in order of place, and sorts its
   suffixes by external induced sorting with common prefixes (see induced.py).
   Among neighbours that share ``window`` bytes the first place stays, and the
   windows at the others are later copies.
4. The spans of each document are joined to its text once.

Bytes are those of the UTF-8 text, matches never cross documents, and memory follows
one text and the tuples a queue holds, not a shard.  NULL text counts as empty.
NULL doc_ids come last in order.  Rows that agree in doc_id and text are one document
and lose the same bytes; equal doc_ids with other texts are ordered by a hash of the
text.  An empty table stays empty; added columns replace columns of the same name.
"""

from __future__ import annotations

import gc
import math
import mmap
import os
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from riskline.llm import induced, winnow
from riskline.llm.text import fresh
from riskline.operators.lineage import written

WINDOW, GRAM = 100, 32
#: Mean bytes of a shard; a task's scratch files take some fifty times as much.
SHARD = 1_000_000
#: Never part of UTF-8, so it separates the runs of a shard.
BETWEEN = 0xFF
KEY = ("z", "d", "b")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents' key (doc_id missing, doc_id, hash of the text) and text."""
    return docs.select(
        F.col("doc_id").isNull().alias("z"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("d"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("b"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.encode(), np.uint8) for t in column.to_pylist()]


RUNS = "copy boolean, again boolean, several boolean, owner long, seg long, left int, right int, z boolean, d long, b long, first int, last int"


def _runs(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """All runs of windows; ``copy`` marks those that start later than an equal one of the same batch.

    ``copy`` follows the batches, so a second evaluation may mark others: all marks are to be read in one
    pass, and the texts should come from files, which a repeated task reads in the same batches.  Copies
    carry their place only, and a number of it as owner, so that they spread.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow.runs(t, window, gram) for t in _bytes(batch.column("text"))]
            if not found:
                continue
            doc = np.repeat(np.arange(len(found)), [len(f.owner) for f in found])
            c = {k: np.concatenate([getattr(f, k) for f in found]) for k in ("again", "several", "owner", "seg", "left", "right", "first", "last")}
            c |= {k: np.asarray(batch.column(k).to_numpy(zero_copy_only=False))[doc] for k in KEY}
            order = np.lexsort((c["first"], c["b"], c["d"], c["z"], c["seg"], c["owner"]))
            c = {k: v[order] for k, v in c.items()}
            new = np.ones(len(order), bool)
            new[1:] = (c["owner"][1:] != c["owner"][:-1]) | (c["seg"][1:] != c["seg"][:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            c["copy"] = ~np.logical_and.reduce([c[k] == c[k][head] for k in (*KEY, "first")])
            c["owner"] = np.where(c["copy"], c["d"].view(np.uint64) + c["first"].astype(np.uint64) * np.uint64(winnow.BASE), c["owner"])
            c |= {k: c[k].view(np.int64) for k in ("owner", "seg")} | {k: c[k].astype(np.int32) for k in ("left", "right", "first", "last")}
            names = [f.split()[0] for f in RUNS.split(", ")]
            hidden = {k: c["copy"] for k in ("again", "several", "seg", "left", "right")}
            yield pa.RecordBatch.from_arrays([pa.array(c[k], mask=hidden.get(k)) for k in names], names)

    return keyed.mapInArrow(find, RUNS)


def _shards(runs: DataFrame, keyed: DataFrame, window: int, n_shards: int) -> DataFrame:
    """(shard, key, first, bytes) of every run, cut from its text."""
    per_doc = runs.groupBy(*KEY).agg(F.collect_list(F.struct(F.pmod(F.xxhash64("owner"), F.lit(n_shards)).alias("s"), "first", "last")).alias("runs"))
    joined = keyed.join(per_doc.hint("shuffle_hash"), list(KEY))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t.encode() for t in part.column("text").to_pylist()]
                rows = [(k, r["s"], r["first"], texts[k][r["first"] : r["last"] + window]) for k, rs in enumerate(part.column("runs").to_pylist()) for r in rs]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[1] for r in rows], pa.int64()), *[part.column(c).take(at) for c in KEY], pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())],
                    ["shard", *KEY, "first", "bytes"],
                )

    return joined.select(*KEY, "text", "runs").mapInArrow(cut, "shard long, z boolean, d long, b long, first int, bytes binary")


class _Shard:
    """The runs of one shard, written to a file one after the other in order of place."""

    def __init__(self, window: int, path: str):
        self.window, self.path = window, path
        self.file = open(os.path.join(path, f"shard-{os.getpid()}"), "w+b")  # noqa: SIM115
        os.unlink(self.file.name)
        self.keys: list[tuple] = []
        self.starts: list[int] = []
        self.size = 0

    def add(self, key: tuple, content: bytes) -> None:
        if self.keys and self.keys[-1] == key:
            return  # the same document, read twice
        self.keys.append(key)
        self.starts.append(self.size)
        self.file.write(content + bytes([BETWEEN]))
        self.size += len(content) + 1

    def later(self) -> Iterator[tuple]:
        """(key, first, last) of the windows that another one equals which starts earlier."""
        self.file.flush()
        n, window = self.size, self.window
        text = np.frombuffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        folder = induced.Folder(self.path)
        marks, fits = folder.zeros(n, np.uint8), folder.zeros(n, np.uint8)
        ends = [s - window for s in [*self.starts[1:], n]]
        for a, e in zip(self.starts, ends, strict=True):
            fits[a:e] = 1
        # Suffixes that share a window with the one before form groups; places lie in the file in
        # order, so the smallest position of a group is the earliest place and stays.
        lowest, shared = -1, 0
        for at, lengths in induced.suffixes(text, window, folder):
            new = lengths < window
            group = np.cumsum(new)
            shared = 0 if new[0] else shared
            if not new[0] and lowest >= 0:
                group += 1  # the group goes on from the block before, whose smallest position comes first
                at, group = np.r_[lowest, at], np.r_[1, group]
                own = np.r_[True, fits[at[1:]] == 1]
            else:
                own = fits[at] == 1
            at, last_group = at[own], group[-1]
            group = group[own]
            lowest = -1
            if len(at):
                edge = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1]
                least = np.minimum.reduceat(at, edge)
                marks[at] = 1
                marks[least] = 0
                if group[-1] == last_group:
                    lowest = int(least[-1])
        for key, a, e in zip(self.keys, self.starts, ends, strict=True):
            edge = np.flatnonzero(np.diff(np.r_[0, marks[a:e], 0].astype(np.int8)))
            for first, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield (*key[:3], key[3] + first, key[3] + stop - 1)


#: Seconds after which the JVM has been told of the plans that Python has dropped; a thread does so once a second.
TOLD = 2


def _released(spark: SparkSession) -> None:
    """Lets the driver drop plans that are done with, so that Spark removes their shuffle files now and not at its next collection."""
    gc.collect()
    time.sleep(TOLD)
    spark.sparkContext._jvm.System.gc()


SPANS = "z boolean, d long, b long, first int, last int"


def _sorted_out(shards: DataFrame, window: int) -> DataFrame:
    """Windows of the shards that are later copies; ``shards`` come sorted by shard and place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as path:  # scratch of this task alone: nothing else reads it
            held, own = None, None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("shard", *KEY, "first", "bytes")]
                for s, z, d, b, first, content in zip(*columns, strict=True):
                    if s != own:
                        if held is not None:
                            yield from packed(held)
                        held, own = _Shard(window, path), s
                    held.add((z, d, b, first), content)
            if held is not None:
                yield from packed(held)

    def packed(shard: _Shard) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in shard.later():
            rows.append(row)
            if len(rows) == 10_000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*KEY, "first", "last"])

    return shards.mapInArrow(work, SPANS)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(z, d, b, first, last): runs of windows of each document that also start earlier."""
    spark, keyed, columns = docs.sparkSession, _keyed(docs), [*KEY, "first", "last"]
    # All runs take more room than the texts: they are shuffled as they are found, and what is left is written.
    met = written(_met(_runs(keyed, window, gram)), "runs")
    _released(spark)
    open_runs = met.where("NOT later AND open")
    total = open_runs.agg(F.sum(F.col("last") - F.col("first") + window + 1)).first()[0] or 0
    n_shards = max(1, math.ceil(total / shard))
    cut = _shards(open_runs, keyed, window, n_shards).repartition(n_shards, "shard").sortWithinPartitions("shard", *KEY, "first")
    spans = written(_sorted_out(cut, window), "spans")
    del cut
    _released(spark)
    return spans.unionByName(met.where("later").select(*columns))


def _met(runs: DataFrame) -> DataFrame:
    """The first of equal runs with whether it is open, that is, goes to the sort, and the later ones.

    Copies have no hash of their bytes and no side, so they change nothing for the runs that share a window group with them.
    """
    per_run = W.partitionBy("owner", "seg").orderBy(*KEY, "first")

    def differ(*by: str) -> Column:
        """Whether the runs that agree in the owner and ``by`` are of several kinds."""
        group = W.partitionBy("owner", *by)
        return F.min("seg").over(group) != F.max("seg").over(group)

    # Equal windows of different runs agree in a side of the owner, unless that stands at several places.
    sides = (F.col("left") >= 0) & differ("left") | (F.col("right") >= 0) & differ("right")
    met = runs.withColumns({
        "open": ~F.col("copy") & (F.col("again") | differ() & (F.max("several").over(W.partitionBy("owner")) | sides)),
        "later": F.col("copy") | (F.rank().over(per_run) > 1),
    })
    return met.where("open OR later").select("owner", *KEY, "first", "last", "later", "open")


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans`` in place of its text."""
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    names = [c for c in docs.columns if c != "text" and c.lower() not in new]
    z, d, b, spans = (fresh(docs.columns, f"_{c}") for c in ("z", "d", "b", "spans"))
    per_doc = repeated_spans(docs, window, gram, shard).groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias(spans))
    per_doc = per_doc.toDF(z, d, b, spans)
    keyed = docs.withColumns({
        z: F.col("doc_id").isNull(), d: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), b: F.xxhash64(F.coalesce("text", F.lit(""))),
    })
    joined = keyed.join(per_doc.hint("shuffle_hash"), [z, d, b], "left").select(*names, "text", spans)
    schema = T.StructType([
        *[docs.schema[c] for c in names], T.StructField("kept", T.BinaryType()),
        *[T.StructField(c, T.LongType()) for c in new[1:]],
    ])

    def cut(text: str | None, rows: list | None) -> tuple[bytes, int, int, int]:
        content = (text or "").encode()
        if not rows:
            return content, len(content), 0, 0
        edges = np.zeros(len(content) + 1, np.int64)
        np.add.at(edges, [r["first"] for r in rows], 1)
        np.add.at(edges, [r["last"] + window for r in rows], -1)
        gone = np.cumsum(edges[:-1]) > 0
        starts = gone & ~np.r_[False, gone[:-1]]
        return np.frombuffer(content, np.uint8)[~gone].tobytes(), len(content), int(gone.sum()), int(starts.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                made = [cut(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True)]
                columns = [pa.array([m[k] for m in made], pa.binary() if k == 0 else pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, *new])

    return joined.mapInArrow(run, schema)

