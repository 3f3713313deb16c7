"""Merkle manifest of a table with a witness for every row, by incremental witnesses.

Every row is a leaf.  Leaves of a group stand in order, and an append-only tree of runs of
``FANOUT`` nodes grows over them: a new leaf joins the open run of the lowest level, a run
that is full, or the last one, closes into a node that joins the open run above, and each
time the witnesses of the leaves below are extended by the siblings of their node.

The appends are spread over tasks by aligned blocks of ``FANOUT ** LEVELS`` leaves.  A task
appends one block and gives its root; block roots are appends of the next round, in blocks
again, until a group has one node, its subroot.  The subroots of all groups are leaves of one
more tree that grows the same way and ends in the root.  On the way back each block
appends its nodes again, and their partial witnesses are extended by that of the block.  No task
holds more than a block, whatever share of the rows a group has.

Places in a group come from one range partitioning by group and order, whose
shares of each group are added up; texts are read once, only digests are shuffled.

Hashes are SHA-256 as lowercase hex over concatenated inputs, digests as hex text.  NULL
groups and order values come first; rows that agree in order stand by digest, so repeated
rows are leaves of their own in a row.  An empty table gives an empty result.  Other columns
pass, whatever their names, but those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.operators.lineage import written

#: Nodes of a run, levels that a block closes, and hex digits of a digest.
FANOUT, LEVELS, HEX = 8, 4, 64

WITNESS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def leaf(*values: Column) -> Column:
    """Digest of a row's values: each ``-`` if NULL, else its UTF-8 byte count, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(digest: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give: the siblings of every level stand around the node below."""
    return F.aggregate(witness, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def siblings(witness: Column) -> Column:
    """The digests of a witness as one text, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), "")


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Appender:
    """An append-only tree of a given height that keeps a witness for everything appended.

    ``witnesses[k]`` are the (left, right) siblings of leaf k and its ancestors as far as
    their runs are closed.
    """

    def __init__(self, levels: int):
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels)]
        self.witnesses: list[list[tuple[str, str]]] = []
        self.root: str | None = None

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        self._join(0, digest, len(self.witnesses) - 1, len(self.witnesses))

    def _join(self, level: int, digest: str, start: int, stop: int) -> None:
        """A node over the leaves from ``start`` to before ``stop`` joins the open run of its level."""
        if level == len(self.open):
            self.root = digest
            return
        self.open[level].append((digest, start, stop))
        if len(self.open[level]) == FANOUT:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        whole = "".join(d for d, _, _ in run)
        for k, (_, start, stop) in enumerate(run):
            step = whole[: HEX * k], whole[HEX * (k + 1) :]
            for witness in self.witnesses[start:stop]:
                witness.append(step)
        self._join(level + 1, hashlib.sha256(whole.encode()).hexdigest(), run[0][1], run[-1][2])

    def finish(self) -> str:
        """Closes the last runs, also those of fewer nodes, and returns the root."""
        for level in range(len(self.open)):
            if self.open[level]:
                self._close(level)
        return self.root


def _appended(nodes: pa.Table, levels: int) -> Appender:
    """The tree over one block of nodes (i, n, digest); ``nodes`` stand in order."""
    tree = Appender(min(levels, height(nodes["n"][0].as_py())))
    for digest in nodes["digest"].to_pylist():
        tree.append(digest)
    tree.finish()
    return tree


def _numbered(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (g, o, digest, ...) with their place ``i`` in the group by (o, digest) and the group's size ``n``."""
    order = ["g", "o", "digest"]
    ranged = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    # Ids follow the rows of a range; their upper bits number the ranges.
    held = written(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    shares = held.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    group = Window.partitionBy("g")
    ahead = F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shares = shares.select(
        F.col("g").alias("in_g"), "part", (F.coalesce(ahead, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(group).alias("n")
    )
    # Written, so that its size is known before the join: a row for each range and group in it.
    shares = written(shares, "shares")
    joined = held.join(shares, F.col("g").eqNullSafe(F.col("in_g")) & (part == F.col("part")))
    return joined.withColumn("i", F.col("at") + F.col("shift")).drop("in_g", "part", "shift", "at", "o")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("b", F.expr(f"i div {FANOUT**levels}"))


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of the blocks of ``nodes`` (g, i, n, digest), which are the nodes of the next round."""

    def close(block: pa.Table) -> pa.Table:
        block = block.sort_by("i")
        n = -(-block["n"][0].as_py() // FANOUT**levels)
        columns = [block["b"].slice(0, 1), pa.array([n], pa.int64()), pa.array([_appended(block, levels).root])]
        return pa.Table.from_arrays([block["g"].slice(0, 1), *columns], ["g", "i", "n", "digest"])

    schema = T.StructType([nodes.schema["g"], *T._parse_datatype_string("i long, n long, digest string").fields])
    return _blocks(nodes.select("g", "i", "n", "digest"), levels).groupBy("g", "b").applyInArrow(close, schema)


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and the block roots of every round, the last of which has one node a group."""
    n = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [nodes]
    while n > 1:
        rounds.append(written(_roots(rounds[-1], levels), "blocks"))
        n = -(-n // FANOUT**levels)
    return rounds


def _nested(witnesses: Iterable[list[tuple[str, str]]]) -> pa.Array:
    """Witnesses as an Arrow array of lists of structs."""
    witnesses = list(witnesses)
    offsets = [0]
    for w in witnesses:
        offsets.append(offsets[-1] + len(w))
    steps = list(chain.from_iterable(witnesses))
    sides = [pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(sides, ["left", "right"]))


def _extended(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with their whole witnesses; ``above`` (g, b, witness, ...) has that of each block, its other columns go to its nodes."""
    passed = [c for c in nodes.columns if c not in ("n", "b")]
    tags = [c for c in above.columns if c not in ("g", "b", "witness")]

    def extend(block: pa.Table, whole: pa.Table) -> pa.Table:
        block = block.sort_by("i")
        upper = [(s["left"], s["right"]) for s in whole["witness"][0].as_py()]
        columns = [block[c] for c in passed] + [_nested(w + upper for w in _appended(block, levels).witnesses)]
        columns += [pa.array([whole[c][0].as_py()] * block.num_rows, whole.schema.field(c).type) for c in tags]
        return pa.Table.from_arrays(columns, [*passed, "witness", *tags])

    schema = T.StructType([nodes.schema[c] for c in passed] + [T.StructField("witness", WITNESS)] + [above.schema[c] for c in tags])
    return _blocks(nodes, levels).groupBy("g", "b").cogroup(above.groupBy("g", "b")).applyInArrow(extend, schema)


def _descended(rounds: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """The nodes of the first round with whole witnesses; ``top`` (g, witness, ...) has those of each group's last node."""
    above, tags = top.withColumn("b", F.lit(0).cast("long")), [c for c in top.columns if c not in ("g", "witness")]
    for nodes in reversed(rounds[1:-1]):
        above = written(_extended(nodes, above, levels).select("g", F.col("i").alias("b"), "witness", *tags), "witnesses")
    return _extended(rounds[0], above, levels)


def manifest(rows: DataFrame, group: str, order: str, digest: str, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``subroot`` of their group, ``root``, and ``witness``, the siblings on the way to the root.

    ``digest`` is the column with a row's leaf, ``order`` the one by which leaves stand in their
    ``group``.  A witness has a (left, right) pair of concatenated digests for each level, so
    ``folded(leaf, witness)`` is the root.  A block closes ``levels`` levels.
    """
    names = [c for c in rows.columns if c.lower() not in ("subroot", "root", "witness")]
    held = {c: f"c{k}" for k, c in enumerate(names)}
    nodes = rows.select(
        F.col(group).alias("g"), F.col(order).alias("o"), F.col(digest).alias("digest"), *[F.col(c).alias(h) for c, h in held.items()]
    )
    rounds = _rounds(_numbered(nodes, "leaves"), levels)
    tops = rounds[-1].select(F.lit(0).alias("g"), F.col("g").alias("o"), "digest", F.col("g").alias("of"))
    upper = _rounds(_numbered(tops, "subroots"), levels)
    root = written(upper[-1].select("g", F.array().cast(WITNESS).alias("witness"), F.col("digest").alias("root")), "root")
    groups = written(_descended(upper, root, levels), "groups")
    top = groups.select(F.col("of").alias("g"), "witness", F.col("digest").alias("subroot"), "root")
    whole = _descended(rounds, top, levels)
    return whole.select(*[F.col(h).alias(c) for c, h in held.items()], "subroot", "root", "witness")
