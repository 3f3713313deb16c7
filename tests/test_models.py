"""Logistic models, weights and whole-analysis invariants."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from riskline.catalog import queries as cat
from riskline.operators import bootstrap, glm, replicates, sampling, survival, weights
from riskline.operators.lineage import written
from riskline.plans import study as st
from riskline.sources import derived, files
from riskline.sources.schema import PANEL


@pytest.fixture(scope="module")
def table(spark):
    copies = sampling.with_poisson_counts(cat.rows(spark, SF).select(*st.MODEL_COLUMNS), 2)
    return written(weights.model_rows(copies, F.col("int") == 1), "copies")


@pytest.fixture(scope="module")
def models(table):
    lv = glm.levels(table, list(weights.INTERVAL_COVARIATES))
    lo, hi = table.agg(F.min("age_start"), F.max("age_start")).first()
    return weights.weight_models(glm.Spline("age_start", lo, hi), lv)


def reference_fit(x, y, w):
    """Plain iteratively reweighted least squares on gathered rows."""
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        v = w * mu * (1 - mu)
        beta = beta + np.linalg.lstsq(x.T @ (x * v[:, None]), x.T @ (w * (y - mu)), rcond=1e-12)[0]
    return beta


def test_fit_matches_plain_least_squares(table, models):
    beta = glm.fit_logits(table, models)
    m = next(m for m in models if m.name == "adherence_num")
    pdf = glm.coded(table.where("rep = 0 and exposed = 0"), [m]).toPandas()
    x = glm._design(pdf, m.terms)
    y, w = pdf["screen"].to_numpy(float), pdf["freq"].to_numpy(float)
    mu = lambda b: 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    got = mu(beta[("adherence_num", 0, 0)])
    assert np.allclose(got, mu(reference_fit(x, y, w)), atol=1e-5)
    assert np.allclose(x.T @ (w * (y - got)), 0, atol=1e-6 * len(y))


@pytest.mark.parametrize("fan", [glm.FAN, 2])
def test_replicates_fitted_together_are_those_of_copies(spark, table, models, monkeypatch, fan):
    """Single rows with multiplicities against a row for every copy; with a narrow tree the sums meet in several steps."""
    monkeypatch.setattr(glm, "FAN", fan)
    drawn, counts = sampling.with_draws(cat.rows(spark, SF).select(*st.MODEL_COLUMNS), 2)
    single = written(weights.model_rows(drawn, F.col("int") == 1).repartition(7), "single")
    together, apart = glm.fit_logits(single, models, counts=counts), glm.fit_logits(table, models)
    assert {(k[0], r, *k[1:]) for k in together for r in range(3)} == set(apart)
    pdf = single.where("exposed = 0")
    for m in models:
        x = glm._design(glm.coded(pdf, [m]).toPandas(), m.terms)
        for k, b in together.items():
            if k[0] == m.name:
                for r in range(3):
                    other = apart[(k[0], r, *k[1:])]
                    assert np.allclose(np.tanh(x @ b[r] / 60), np.tanh(x @ other / 60), atol=1e-4)


def copied_curves(spark, rows, reps, kind, cap, fit, counts_by):
    """The same analysis with a row for every person and replicate."""
    parts = []
    for r in range(reps + 1):
        once = rows.join(counts_by.where(F.col("rep") == r).select("bene_id", "mult"), "bene_id")
        models, beta = fit
        coefs = weights.coefficients(spark, models, {k: b[r] for k, b in beta.items()})
        scored = weights.interval_weights(once.withColumn("rep", F.lit(r)), models, coefs, F.col("int") == 1)
        parts.append(weights.cumulative_weights(scored))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = written(whole, "whole")
    if kind == "exposure":
        return survival.cumulative_incidence(whole, ["rep", "exposed"], weight=F.col("wt_final_exposure") * F.col("mult"))
    summ = written(weights.weight_summary(whole, freq=F.col("mult")), "summ")
    cut = weights.truncate_weight(whole.where("cum_screen = 1"), summ, cap=cap)
    return survival.cumulative_incidence(cut, ["rep", "exposed"], weight=F.col("wt_final") * F.col("mult"))


@pytest.mark.parametrize("kind, method, cap, grid", [("adherence", "poisson", 100.0, 10**6), ("adherence", "multinomial", 1.05, 60), ("exposure", "poisson", 0.0, 60)])
def test_curves_from_single_rows_are_those_of_copies(spark, monkeypatch, kind, method, cap, grid):
    """All replicates, with truncated weights, and with event times in several blocks."""
    monkeypatch.setattr(bootstrap, "GRID", grid)
    rows = written(cat.rows(spark, SF).select(*st.MODEL_COLUMNS), "rows")
    table, counts = st.model_table(rows, 2, 1, method)
    fit = weights.fit_weight_models(table, counts=counts)
    design = bootstrap.Design(kind, survival.CAUSES, cap=cap if kind == "adherence" else None)
    if method == "multinomial":
        by = sampling.multinomial_counts(rows.select("bene_id").distinct(), 2)
    else:
        by = sampling.with_poisson_counts(rows.select("bene_id").distinct(), 2)
    marked = weights.model_rows(rows, F.col("int") == 1)
    key = lambda r: (r["rep"], r["exposed"], r["time"])
    got = {key(r): r for r in st.replicate_curves(table, counts, design, *fit).collect()}
    want = {key(r): r for r in copied_curves(spark, marked, 2, kind, cap, fit, by).collect()}
    assert got.keys() == want.keys() and len({k[0] for k in got}) == 3
    for k, r in want.items():
        for c in ("n_risk", "n_primary", "n_competing", "surv", "risk_primary", "risk_competing"):
            assert (r[c] is None and got[k][c] is None) or got[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9)


def test_rows_are_not_copied(spark):
    """No stage of the bootstrap makes rows per replicate before they are summed."""
    table, counts = st.model_table(cat.rows(spark, SF), 5)
    assert table.count() == cat.rows(spark, SF).count()
    sums = bootstrap.replicate_sums(table, counts, bootstrap.Design("count", survival.CAUSES))
    text = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "Join" not in text
    with pytest.raises(ValueError):
        sampling.with_draws(table, 2, method="other")
    with pytest.raises(ValueError):
        bootstrap.Design("other")


def test_pieces_of_a_partition():
    """Rows of one key stay together, and no row is lost."""
    rng = np.random.default_rng(1)
    for size, key in [(1, "k"), (replicates.CELLS // 64, "k"), (replicates.CELLS // 64, None)]:
        ids = np.repeat(np.arange(300), rng.integers(1, 150, 300))
        frame = pd.DataFrame({"k": ids, "i": np.arange(len(ids))})
        batches = [pa.RecordBatch.from_pandas(frame.iloc[i : i + 700], preserve_index=False) for i in range(0, len(frame), 700)]
        got = list(replicates.chunks(iter(batches), size, key))
        assert pd.concat(got)["i"].tolist() == frame["i"].tolist()
        if key:
            assert all(a["k"].iloc[-1] != b["k"].iloc[0] for a, b in zip(got, got[1:]))
    assert list(replicates.chunks(iter([]), 3, "k")) == []


def test_fitted_expression_matches_design(spark, table, models):
    m = next(m for m in models if m.name == "stay_den")
    b = np.linspace(-0.5, 0.5, m.size)
    p = glm.fitted(m.terms, F.array(*[F.lit(float(v)) for v in b])).alias("p")
    got = sorted(r["p"] for r in table.select(p).collect())
    x = glm._design(glm.coded(table, [m]).toPandas(), m.terms)
    assert np.allclose(got, sorted(1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))))


def test_weights_average_to_one_and_ignore_row_order(spark):
    rows = cat.rows(spark, SF)
    w = written(st.interval_weights(rows), "w")
    exposure = w.where("int = 1").agg(F.avg("wt_exposure")).first()[0]
    assert exposure == pytest.approx(1.0, abs=0.2)
    shuffled = st.interval_weights(rows.repartition(11, F.rand(3)))
    key = lambda d: {(r["bene_id"], r["int"]): r["wt_final"] for r in d.select("bene_id", "int", "wt_final").collect()}
    a, b = key(w), key(shuffled)
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_drop_row_and_deviation_have_no_weight(spark):
    w = st.interval_weights(cat.rows(spark, SF))
    assert w.where("(drop = 1 or cum_screen = 0) and wt_final <> 0").count() == 0


def test_probabilities_sum_to_one_and_curves_rise(spark):
    curve = survival.cumulative_incidence(cat.rows(spark, SF), ["exposed"]).orderBy("exposed", "time").collect()
    last = {}
    for r in curve:
        assert r["surv"] + r["risk_primary"] + r["risk_competing"] == pytest.approx(1.0)
        before = last.get(r["exposed"], (0.0, 0.0))
        assert r["risk_primary"] >= before[0] and r["risk_competing"] >= before[1]
        last[r["exposed"]] = (r["risk_primary"], r["risk_competing"])


def test_intervals_join_up(spark):
    p = cat.panel_table(spark, SF)
    follow = p.alias("a").join(p.alias("b"), F.expr("a.bene_id = b.bene_id and b.int = a.int + 1"))
    assert follow.where("abs(a.age_end - b.age_start) > 1e-9").count() == 0
    assert p.groupBy("bene_id").agg((F.max("int") - F.count("*")).alias("d")).where("d <> 0").count() == 0


def test_multinomial_analysis_runs(spark):
    res = st.weighted_analysis(
        cat.panel_table(spark, SF), 2, reps=2, fractions={1: 1.0, 0: 1.0}, method="multinomial", periods=derived.PERIODS
    )
    rows = res.collect()
    assert rows and all(r["risk_primary0_ll"] <= r["risk_primary0_ul"] for r in rows)


def test_crude_kind_returns_limits(spark):
    res = st.weighted_analysis(cat.panel_table(spark, SF), 2, "crude", periods=derived.PERIODS).collect()
    assert all(r["lower"] <= r["estimate"] <= r["upper"] for r in res if r["lower"] is not None)


def test_presets_differ_in_one_parameter():
    main = st.PRESETS["main"]
    changed = {n: [f for f in main.__dataclass_fields__ if f != "name" and getattr(p, f) != getattr(main, f)] for n, p in st.PRESETS.items()}
    assert changed == {
        "main": [], "post2010": ["window_from"], "related6mo": ["refractory_years"],
        "colonoscopy": ["include_types", "exclude_types"],
    }


def test_panel_file_names_are_understood(spark, tmp_path):
    from riskline.sources.schema import EVENT_LABELS, PANEL_RENAMES

    p = cat.panel_table(spark, SF)
    theirs = p.withColumnsRenamed({v: k for k, v in PANEL_RENAMES.items()})
    label = F.create_map(*[F.lit(x) for pair in ((v, k) for k, v in EVENT_LABELS.items()) for x in pair])
    theirs = theirs.withColumn("first_event", label[F.col("first_event")])
    path = str(tmp_path / "panel")
    files.write_result(theirs, path, "csv")
    back = files.read_panel_csv(spark, path)
    assert back.schema.names == PANEL.names
    assert back.exceptAll(p).count() == 0 and p.exceptAll(back).count() == 0


def test_stratum_read_is_pruned(spark, tmp_path):
    root = str(tmp_path)
    files.write_panel(cat.panel_table(spark, SF), root, "main")
    df = files.read_panel(spark, root, "main", ("race", 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(race" in plan
    assert {r["race"] for r in df.select("race").distinct().collect()} == {2}


def test_checkpoint_folder_is_required_off_local(spark, monkeypatch):
    from riskline.operators import lineage

    class Fake:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master = "spark://host"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Fake)
