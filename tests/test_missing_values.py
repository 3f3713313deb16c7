"""Rows that the derived tables do not hold: missing values and levels, extreme weights, changed inputs."""

import shutil
import warnings

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from riskline.catalog import queries as cat
from riskline.operators import events as ev
from riskline.operators import glm, quantiles, summary, survival, weights
from riskline.operators.lineage import remove_tables, written


def test_incomplete_rows_take_no_part_in_a_fit(spark):
    rows = [(0, y, lv, 1) for lv, ys in ((1, [0, 0, 1, 1]), (2, [1, 0, 0, 0]), (None, [1, 1, 1, 1])) for y in ys] + [(0, None, 1, 1)]
    df = spark.createDataFrame(rows, "rep int, y int, g int, freq int")
    model = glm.Logit("m", "y", (glm.Category("g", (1, 2)),))
    beta = glm.fit_logits(written(df, "t"), [model])[("m", 0)]
    p = glm.fitted(model.terms, F.array(*[F.lit(float(b)) for b in beta]))
    got = {r["g"]: r["p"] for r in df.union(spark.createDataFrame([(0, 1, 9, 1)], df.schema)).select("g", p.alias("p")).distinct().collect()}
    assert got[1] == pytest.approx(0.5) and got[2] == pytest.approx(0.25) and got[None] is None and got[9] is None


def test_unlisted_level_is_an_error(spark):
    df = written(spark.createDataFrame([(0, 1, 3, 1), (0, 0, 1, 1)], "rep int, y int, g int, freq int"), "t")
    with pytest.raises(Exception, match="does not list"):
        glm.fit_logits(df, [glm.Logit("m", "y", (glm.Category("g", (1, 2)),))])


def test_unsettled_fit_is_reported(spark):
    df = written(spark.createDataFrame([(0, int(x > 3), float(x), 1) for x in range(8)], "rep int, y int, x double, freq int"), "t")
    with pytest.warns(UserWarning, match="not converged"):
        glm.fit_logits(df, [glm.Logit("m", "y", (glm.Numeric("x"),))], max_iter=2)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        glm.fit_logits(df, [glm.Logit("m", "y", ())])


def test_missing_weight_stays(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 150.0), (None, 200.0)], "age int, w double")
    p95 = spark.createDataFrame([(1, 90.0), (None, 80.0)], "age int, p95_wt double")
    out = weights.truncate_weight(df, p95, ["age"], "w").collect()
    assert sorted(((r["age"], r["w"]) for r in out), key=str) == sorted([(1, 1.0), (1, None), (1, 90.0), (None, 80.0)], key=str)


def test_large_weight_leaving_early(spark):
    rows = [(1, 50.0, 51.0, 0, 1e16), (1, 50.0, 53.0, 1, 0.6), (1, 50.5, 54.0, 2, 0.3), (1, 50.0, 55.0, 1, 1e-9)]
    df = spark.createDataFrame(rows, "g int, age_start double, age_end double, event int, w double")
    curve = {r["time"]: r for r in survival.cumulative_incidence(df, ["g"], weight=F.col("w"), origin=None).collect()}
    assert curve[53.0]["n_risk"] == pytest.approx(0.9, rel=1e-8) and curve[54.0]["n_risk"] == pytest.approx(0.3, rel=1e-8)
    for r in curve.values():
        assert r["surv"] + r["risk_primary"] + r["risk_competing"] == pytest.approx(1.0, abs=1e-9)


def test_missing_group_and_infinite_values(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", float("inf")), ("a", 2.0), ("a", float("nan")), ("a", None), ("b", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in quantiles.exact_quantiles(df, ["g"], "v", (0, 0.5, 1), ("lo", "mid", "hi")).collect()}
    assert got == {None: (1.0, 2.0, 3.0), "a": (2.0, float("inf"), float("inf")), "b": (float("-inf"),) * 3}
    stats = {r["g"]: r["n"] for r in summary.summary_stats(df, "v", ["g"]).collect()}
    assert stats == {None: 2, "a": 2, "b": 1}


def test_weighted_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    value, freq = rng.normal(size=500).round(1), rng.integers(0, 4, 500)
    df = spark.createDataFrame([(1, float(v), int(f)) for v, f in zip(value, freq, strict=True)], "g int, v double, f int")
    got = quantiles.exact_quantiles(df, ["g"], "v", (0.05, 0.5, 0.95), ("a", "b", "c"), F.col("f")).first()
    assert np.allclose([got["a"], got["b"], got["c"]], np.quantile(np.repeat(value, freq), (0.05, 0.5, 0.95)))


def test_frequent_value_is_spread(spark):
    """95 of 100 rows have one value: the ranges hold about equally many distinct ones, and quantiles are exact."""
    value = F.when(F.col("id") % 20 == 0, F.rand(5)).otherwise(F.lit(1.0))
    df = written(spark.range(200_000).select(F.lit("a").alias("g"), value.alias("v")), "frequent")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = quantiles.histogram(df, ["g"], "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in held.groupBy("_part").count().collect()]
    assert sum(sizes) == 10_001 and len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    probs = {f"q{p}": p / 100 for p in (0, 1, 3, 5, 50, 100)}
    got = quantiles.group_summary(df, ["g"], "v", probs, names={"n": "n", "mean": "m"}).first()
    values = np.array([r["v"] for r in df.collect()])
    assert np.allclose([got[c] for c in probs], np.quantile(values, list(probs.values())), rtol=0, atol=1e-15)
    assert got["n"] == 200_000 and got["m"] == pytest.approx(values.mean())


def test_quantile_plan_has_five_exchanges(spark):
    """Counted over the written steps: histogram, ranges, shares, their order, and the rows of the wanted ranks."""
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.rand(1).alias("v"))
    plan = quantiles.exact_quantiles(df, ["g"], "v", [0.5], ["m"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "BroadcastHashJoin" in plan


def test_procedures_of_one_day_are_all_enrolled(spark):
    people = spark.sql("select 'A' bene_id, date'2000-01-01' baseline, date'2001-01-01' end_date, date'2000-01-01' min_age_date")
    procs = spark.sql("select 'A' bene_id, t proc_type, date'2000-05-01' proc_date from values (1), (2), (1) as v(t)")
    assert ev.attach_enrollment(procs, people).count() == 3


def test_changed_files_give_another_panel(spark, tmp_path):
    for name in ("customer", "orders"):
        shutil.copyfile(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    first = cat.panel_table(spark, str(tmp_path)).count()
    spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey % 2 = 0").toPandas().to_parquet(tmp_path / "customer.parquet")
    assert 0 < cat.panel_table(spark, str(tmp_path)).count() < first


def test_written_tables_can_be_removed(spark):
    table = written(spark.range(3), "gone")
    path = table.inputFiles()[0]
    assert remove_tables(spark) >= 1
    cat._PANELS.clear()
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path)
