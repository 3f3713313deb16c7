"""Every registered query against the same question asked in SQL."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from riskline.catalog.queries import REGISTRY

ROWS_ONLY = sorted(n for n, e in REGISTRY.items() if e.sql is None)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return "" if value is None else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_agrees_with_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) > 0
    assert got[1] == want[1]


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["panel_full", "cif_crude", "bootstrap_curves", "cum_adherence", "thin_events_1y"])
def test_plan_has_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan


def test_panel_needs_one_window_only(spark):
    plan = entry.queries()["panel_full"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1


def test_copies_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    from riskline.operators import sampling
    from riskline.operators.weights import cumulative_weights

    df = spark.range(100).select(
        F.concat(F.lit("A"), F.col("id") % 10).alias("bene_id"), F.col("id").alias("int"),
        *[F.lit(1.0).alias(c) for c in ("cum_screen", "wt_exposure", "wt_screen", "wt_drop")],
    )
    plan = cumulative_weights(sampling.with_poisson_counts(df.repartition("bene_id"), 3))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
