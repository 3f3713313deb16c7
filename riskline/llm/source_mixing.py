"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target: its weighted share of the words of the mix, stopped at
a multiple of its own size, with the excess shared anew by weight.  A document of
a source is to be taken target / source_size times; the whole part is certain and
the fraction is a probability, rounded by pivotal sampling: two documents meet,
words of probability pass between them in a random direction until one
probability is 0 or 1, and the other goes on.  As words are passed, not counts,
the expected words of the source stay what they are at every step, and the one
document left over at the end is all that the total can miss its target by.
Documents meet in order of falling size, so that one is small.

The rounding is a reduction tree: documents are dealt by hash into groups of
bounded mean size, each leaves at most one undecided document, and those meet
in groups again until one per source is left.  A hot source has more groups,
not larger ones.  Random numbers come from the seed and the group's place in the
tree, and the order in a group from its rows, so reruns agree.

NULL text has size 0, and documents of size 0 are taken 0 times.  NULL is a
source like any other, last in order.  Rows that agree in doc_id and size may
change places among themselves.  An empty table gives an empty result; other
columns pass unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskline.llm.text import SPACES, fresh
from riskline.operators.lineage import written

WEIGHTS, BUDGET, CEILING, SEED = (3, 1, 2), 1.5, 2.0, 42
#: Mean documents of a group at the leaves, and undecided documents that meet further up.
LEAF, FAN = 2_000, 64
EXACT = 1e-9


def size_of(text: Column) -> Column:
    """Number of words."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their number from 0 by code point, NULL last: ranges of sources are counted, none is gathered."""
    first = F.col("source").asc_nulls_last()
    parts = written(sources.repartitionByRange(first).withColumn("part", F.spark_partition_id()), "sources")
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(first)) - 1
    return parts.withColumn("inside", inside).join(before, "part").withColumn("number", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def with_targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING) -> DataFrame:
    """(source, n, source_size, number, target) from (source, n, source_size)."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = written(numbered(sources).withColumn("weight", F.get(cycle, (F.col("number") % len(weights)).cast("int"))), "weights")
    cap = F.col("source_size") * F.lit(float(ceiling))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, stopped = 0.0, -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        full, open_weight, n = table.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)
        ).first()
        if n == stopped or not open_weight:
            break
        stopped, level = n, (total - full) / open_weight
    reached = F.lit(level) * F.col("weight") if open_weight else cap
    return table.withColumn("target", F.least(cap, reached)).drop("weight")


def _settle(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Lets the undecided documents of a group meet; at most one stays undecided (``share`` strictly between 0 and 1)."""
    pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last", kind="stable", ignore_index=True)
    size, share = pdf["size"].to_numpy(float), pdf["share"].to_numpy(float).copy()
    draws = np.random.default_rng(seed).random(len(pdf))
    a = -1
    for b in range(len(pdf)):
        if not EXACT < share[b] < 1 - EXACT:
            share[b] = round(share[b])
            continue
        if a < 0:
            a = b
            continue
        # In words: what can pass to a, and what can pass to b.
        up = min((1 - share[a]) * size[a], share[b] * size[b])
        down = min(share[a] * size[a], (1 - share[b]) * size[b])
        moved = up if draws[b] * (up + down) < down else -down
        share[a] += moved / size[a]
        share[b] -= moved / size[b]
        settled = [i for i in (a, b) if not EXACT < share[i] < 1 - EXACT]
        for i in settled:
            share[i] = round(share[i])
        left = [i for i in (a, b) if i not in settled]
        a = left[0] if left else -1
    return pdf.assign(share=share)


def _level(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        own = xxhash.xxh64_intdigest(f"{seed}/{level}/{pdf['number'].iloc[0]}/{pdf['part'].iloc[0]}")
        out = _settle(pdf, own)
        if last:
            draw = np.random.default_rng(own ^ 1).random(len(out))
            out["share"] = np.where(np.isin(out["share"], (0.0, 1.0)), out["share"], (draw < out["share"]).astype(float))
        return out[list(pdf.columns)]

    return rows.groupBy("number", "part").applyInPandas(meet, rows.schema)


def copies(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies) from (row, doc_id, source, size)."""
    sources = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    info = written(with_targets(sources, weights, budget, ceiling), "targets")
    held = info.withColumnRenamed("source", "own")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    groups = F.ceil(F.col("n") / F.lit(LEAF))
    rows = sized.join(held, F.col("source").eqNullSafe(F.col("own"))).select(
        "row", F.col("doc_id").cast("string").alias("doc_id"), "size", "source_size", "target", "number",
        F.pmod(F.xxhash64("doc_id", "size"), groups).cast("bigint").alias("part"),
        F.when(F.col("size") > 0, F.floor(rate)).otherwise(F.lit(0)).cast("bigint").alias("whole"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)).alias("share"),
    )
    most = info.agg(F.max("n")).first()[0] or 0
    parts, level = math.ceil(most / LEAF), 0
    done: list[DataFrame] = []
    while True:
        settled = written(_level(rows, level, parts <= 1, seed), "settled")
        decided = (F.col("share") == 0) | (F.col("share") == 1)
        done.append(settled.where(decided))
        if parts <= 1:
            break
        rows = settled.where(~decided).withColumn("part", F.floor(F.col("part") / F.lit(FAN)).cast("bigint"))
        parts, level = math.ceil(parts / FAN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("row", F.col("doc_id").cast(dict(sized.dtypes)["doc_id"]).alias("doc_id"), "size", "source_size", "target",
                      (F.col("whole") + F.col("share").cast("bigint")).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of ``docs``."""
    sized = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    made = copies(written(sized, "sized"), weights, budget, ceiling, seed)
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """The rows of the mix: those of ``docs``, each as often as it is taken."""
    row = fresh(docs.columns, "_row")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "held")
    sized = held.select(F.col(row).alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    often = fresh([*docs.columns, row], "_copies")
    taken = copies(written(sized, "sized"), weights, budget, ceiling, seed).where("copies > 0")
    many = taken.select(F.col("row").alias(row), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias(often))
    return held.join(many.hint("shuffle_hash"), row).select(*docs.columns)
