"""Person-level sampling and bootstrap resampling.

Draws are functions of (seed, replicate, person), so they need no ordering and
are the same after a task is lost and rerun.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.functions.expressions import hash_uniform
from riskline.operators.replicates import Counts, Listed, Once, Poisson


def _fraction(stratum: Column, fractions: Mapping[int, float]) -> Column:
    expr = None
    for level, p in fractions.items():
        expr = F.when(stratum == level, p) if expr is None else expr.when(stratum == level, p)
    return expr.otherwise(0.0)


def sample_persons(
    df: DataFrame,
    fractions: Mapping[int, float],
    key: str = "bene_id",
    stratum: str = "exposed",
    seed: int = 123,
) -> DataFrame:
    """All rows of a Bernoulli sample of people, with a fraction per stratum.

    A person is kept or dropped as a whole because the draw uses only the id.
    """
    return df.where(hash_uniform(seed, F.col(key)) < _fraction(F.col(stratum), fractions))


def sampling_weight(fractions: Mapping[int, float], stratum: str = "exposed") -> Column:
    """Inverse of the stratum's sampling fraction."""
    return F.lit(1.0) / _fraction(F.col(stratum), fractions)


# Modulus of the replicate draws: the Mersenne prime 2**31 - 1, so that products fit 64 bits.
MODULUS = 2**31 - 1


def poisson_thresholds() -> list[int]:
    """Smallest draw in [0, MODULUS) that exceeds each Poisson(1) count 0, 1, 2, …"""
    below, out = 0.0, []
    for k in range(20):
        below += math.exp(-1.0) / math.factorial(k)
        step = math.ceil(below * MODULUS)
        if step >= MODULUS:
            break
        out.append(step)
    return out


def replicate_coefficients(reps: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(rep, a, c, b) of the draw ``(a*h1 + c*h2 + b) mod MODULUS`` of every replicate.

    Replicate 0 draws the constant that stands for a count of one.
    """

    def number(rep: int, tag: str) -> int:
        return int(hashlib.md5(f"{seed}:{rep}:{tag}".encode()).hexdigest()[:15], 16) % (MODULUS - 1) + 1

    drawn = [(r, number(r, "a"), number(r, "c"), number(r, "b")) for r in range(1, reps + 1)]
    return [(0, 0, 0, poisson_thresholds()[0]), *drawn]


def with_person_words(df: DataFrame, key: str = "bene_id") -> DataFrame:
    """Two 28-bit hash words of the id, ``_h1`` and ``_h2``; hashed once however many replicates follow."""
    digest = F.md5(F.col(key).cast("binary"))
    return df.withColumn("_digest", digest).withColumns(
        {f"_h{i + 1}": F.conv(F.substring("_digest", 7 * i + 1, 7), 16, 10).cast("bigint") for i in (0, 1)}
    ).drop("_digest")


def with_poisson_counts(df: DataFrame, reps: int, seed: int = 1, key: str = "bene_id") -> DataFrame:
    """Rows per replicate 0..reps with the person's multiplicity ``mult``; replicate 0 is the original.

    The count is a function of replicate and id, computed where the row is: no
    shuffle, no join, equal on all rows of a person.  Copies drawn zero times are
    left out before any further step.
    """
    if reps == 0:
        return df.withColumns({"rep": F.lit(0), "mult": F.lit(1)})
    if "_h1" not in df.columns:
        df = with_person_words(df, key)
    entries = F.array(
        *[
            F.struct(F.lit(r).alias("rep"), *[F.lit(v).cast("bigint").alias(n) for n, v in zip("acb", rest)])
            for r, *rest in replicate_coefficients(reps, seed)
        ]
    )
    x = (F.col("_r.a") * F.col("_h1") + F.col("_r.c") * F.col("_h2") + F.col("_r.b")) % F.lit(MODULUS)
    steps = poisson_thresholds()
    count = F.when(F.col("_x") < steps[1], 1)
    for k, step in enumerate(steps[2:], start=2):
        count = count.when(F.col("_x") < step, k)
    out = df.withColumn("_r", F.explode(entries)).withColumn("_x", x).where(F.col("_x") >= steps[0])
    return out.withColumns({"rep": F.col("_r.rep"), "mult": count.otherwise(len(steps))}).drop("_r", "_x", "_h1", "_h2")


def dense_index(ids: DataFrame, key: str = "bene_id") -> DataFrame:
    """Number distinct ids 0..n-1 without gathering them in one task.

    Ids are numbered inside 65,536 hash buckets; only the bucket sizes are added
    up in one ordered window.
    """
    ids = ids.select(key, F.substring(F.md5(F.col(key).cast("binary")), 1, 4).alias("bucket"))
    sizes = ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(key)) - 1
    return ids.withColumn("rank", rank).join(offsets, "bucket").select(
        key, (F.col("offset") + F.col("rank")).alias("idx")
    )


def multinomial_counts(ids: DataFrame, reps: int, seed: int = 1, key: str = "bene_id") -> DataFrame:
    """(rep, id, mult) of ``reps`` resamples of n from n people with replacement, plus replicate 0.

    Every draw is one generated row; draws combine map-side to counts per index.
    """
    n = ids.count()
    number = hash_uniform(seed, F.col("rep"), F.col("draw")) * F.lit(n)
    draws = (
        ids.sparkSession.range(reps * n)
        .select((F.floor(F.col("id") / n) + 1).cast("int").alias("rep"), (F.col("id") % n).alias("draw"))
        .select("rep", F.floor(number).alias("idx"))
        .groupBy("rep", "idx")
        .agg(F.count(F.lit(1)).cast("int").alias("mult"))
    )
    drawn = draws.join(dense_index(ids, key), "idx").select("rep", key, "mult")
    return ids.select(F.lit(0).alias("rep"), key, F.lit(1).alias("mult")).unionByName(drawn)


def with_draws(df: DataFrame, reps: int, seed: int = 1, method: str = "poisson", key: str = "bene_id") -> tuple[DataFrame, Counts]:
    """``df`` with what its tasks need to draw the multiplicities of replicates 0..reps, and the object that draws them.

    Rows stay single.  ``poisson`` adds two hash words, ``multinomial`` joins one row a person
    that holds all its counts.
    """
    if method not in ("poisson", "multinomial"):
        raise ValueError(f"unknown method {method!r}")
    if reps == 0:
        return df, Once()
    if method == "poisson":
        drawn = Poisson(tuple((a, c, b) for _, a, c, b in replicate_coefficients(reps, seed)), tuple(poisson_thresholds()), MODULUS)
        return with_person_words(df, key), drawn
    counts = multinomial_counts(df.select(key).distinct(), reps, seed, key)
    per = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rep", "mult"))).alias("_by"))
    every = F.transform(
        F.sequence(F.lit(0), F.lit(reps)), lambda r: F.lpad(F.hex(F.coalesce(F.try_element_at("_by", r), F.lit(0))), 4, "0")
    )
    return df.join(per.select(key, F.unhex(F.array_join(every, "")).alias("_drawn")), key), Listed(reps + 1)


def replicate_rows(df: DataFrame, key: str = "bene_id") -> DataFrame:
    """Physical copies according to ``mult``, each person copy with its own id ``bid``."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mult"))))
    return copies.withColumn("bid", F.concat_ws("#", F.col(key), F.col("copy")))
