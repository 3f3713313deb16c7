"""Cohort inputs derived from the given customer and order tables.

A customer is a person and an order a procedure.  The expressions use integer
arithmetic with coprime moduli only, so any SQL engine derives the same rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.sources.schema import CONDITIONS

# Study parameters used with the derived cohort.
CUTOFF = date(2001, 6, 30)
WINDOW_FROM = date(1998, 1, 1)
PERIODS = ((1995, 1996), (1997, 1998))
PROTOCOL_YEARS = 2

# Multipliers and moduli of the condition dates, one entry per condition.
_P = (59, 61, 67, 71, 73, 79, 83, 29, 23, 19, 13, 17, 7, 5)
_Q = (113, 127, 131, 137, 139, 149, 151, 157, 163, 167, 173, 179, 181, 191)
_R = (20, 25, 30, 12, 15, 18, 22, 16, 14, 24, 28, 10, 17, 26)
_M = (3, 5, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53)

_ANY = """case when (c_custkey*43) % 107 < 12 then st + cast(100 + (c_custkey*17) % 2000 as int)
  when (c_custkey*47) % 109 < 9 then st + cast(50 + (c_custkey*19) % 2000 as int) end"""

SUBJECT_SQL = (
    "concat('C', cast(c_custkey as varchar(20))) as bene_id",
    """case when (c_custkey*53) % 89 < 50 then 1 when (c_custkey*53) % 89 < 70 then 2
  when (c_custkey*53) % 89 < 86 then 3 end as race""",
    "case when (c_custkey*31) % 97 < 48 then 'M' else 'F' end as sex",
    "cast(c_nationkey % 5 as varchar(20)) as first_elig_state",
    "st as start_date",
    "st + cast(700 + (c_custkey*53) % 1700 as int) as end_date",
    "date '1935-01-01' + cast((c_custkey*97) % 4383 as int) as dob",
    "case when (c_custkey*41) % 103 < 15 then st + cast(150 + (c_custkey*31) % 2000 as int) end as dod",
    "case when (c_custkey*37) % 101 < 30 then st + cast((c_custkey*7) % 365 as int) end as exposure_date",
    f"{_ANY} as any_date_type1",
    f"{_ANY} as any_date_type2",
    "case when (c_custkey*43) % 107 < 12 then st + cast(100 + (c_custkey*17) % 2000 as int) end as primary_date",
    """case when (c_custkey*43) % 107 < 3
  then st + cast(100 + (c_custkey*17) % 2000 + c_custkey % 90 as int) end as exclusion_date""",
    *[
        f"case when (c_custkey*{p}) % {q} < {r} then st + cast((c_custkey*{m}) % 2000 - 200 as int) end as cond_{c}_date"
        for c, p, q, r, m in zip(CONDITIONS, _P, _Q, _R, _M)
    ],
)

PROCEDURE_SQL = (
    "concat('C', cast(o_custkey as varchar(20))) as bene_id",
    "cast(substr(o_orderpriority,1,1) as int) as proc_type",
    "cast(o_orderdate as date) as proc_date",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with orders; the first order date starts enrolment.

    The derived columns come out of a one-element array, so that filters on them
    are not rewritten into filters on the long expressions behind them.
    """
    first_order = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("st")
    )
    joined = table(spark, sf_dir, "customer").join(first_order, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select(F.explode(F.array(F.struct(*map(F.expr, SUBJECT_SQL)))).alias("s")).select("s.*")


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*PROCEDURE_SQL)
