"""Fits and scores on tables whose files are few and small but whose rows are many."""

import contextlib
import io
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from riskline.operators import glm, weights
from riskline.operators.lineage import written


def people(spark, n=1000):
    """Rows of made-up people, three each, with all columns that the weight models read."""
    return spark.range(n * 3).selectExpr(
        "concat('p', id div 3) AS bene_id", "cast(id % 3 + 1 AS int) AS int", "cast((id div 3) % 7 < 3 AS int) AS exposed",
        "cast(id % 37 = 0 AS int) AS drop", "50 + (id div 3 * 13) % 97 / 10 + (id % 3) / 4 AS age_start", "cast((id * 7) % 11 < 8 AS int) AS screen",
        "cast((id * 5) % 13 < 9 AS int) AS screen_1", "cast((id * 3) % 17 < 9 AS int) AS screen_2", "1 AS cum_screen",
        "cast((id div 3) % 3 + 1 AS int) AS race", "if((id div 3) % 5 < 2, 'F', 'M') AS sex", "cast((id div 3 * 3) % 4 AS string) AS first_elig_state",
        "cast((id * 11) % 3 AS int) AS n_cond", "cast((id * 17) % 5 % 3 AS int) AS n_cond_1", "cast((id div 3) % 11 % 2 + 1 AS int) AS enroll_period", "0 AS rep",
    )


@pytest.fixture
def fit(spark):
    table = written(weights.model_rows(people(spark), F.col("int") == 1).coalesce(1), "one-file")
    return table, *weights.fit_weight_models(table)


def test_rows_of_one_file_are_fitted_in_many_tasks(spark, monkeypatch, tmp_path):
    table = written(people(spark).withColumn("freq", F.lit(1)).coalesce(1), "one-file")
    model = glm.Logit("m", "screen", (glm.Numeric("screen_1"), glm.Category("race", (1, 2, 3))))
    alone = glm.fit_logits(table, [model])
    monkeypatch.setattr(glm, "PIECE", 100, raising=False)
    plain = glm._cross_products

    def noted(x, y, freq, beta):
        open(os.path.join(tmp_path, f"{TaskContext.get().partitionId()}-{len(x)}"), "w").close()
        return plain(x, y, freq, beta)

    monkeypatch.setattr(glm, "_cross_products", noted)
    monkeypatch.setattr(glm, "FAN", 3)
    spread = glm.fit_logits(table, [model])
    sizes = [int(name.split("-")[1]) for name in os.listdir(tmp_path)]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 2 * 3000 / len(sizes)
    assert np.allclose(alone[("m", 0)], spread[("m", 0)], atol=1e-8)


@pytest.mark.parametrize("size", [1, 3])
def test_cross_products_are_those_of_the_formula(size):
    rng = np.random.default_rng(4)
    x, y, freq, beta = rng.normal(size=(60, 5)), rng.integers(0, 2, 60).astype(float), rng.integers(0, 4, (60, size)), rng.normal(size=(size, 5)) * 9
    out = glm._cross_products(x, y, freq, beta)
    for r in range(size):
        eta = np.clip(x @ beta[r], -30, 30)
        mu = 1 / (1 + np.exp(-eta))
        w = freq[:, r] * mu * (1 - mu)
        left = (x * w[:, None]).T @ x
        expected = [*left[np.triu_indices(5)], *(x.T @ (w * eta + freq[:, r] * (y - mu))), 2 * np.sum(freq[:, r] * np.logaddexp(0, np.where(y == 1, -eta, eta)))]
        assert np.allclose(out[:, r], expected, rtol=1e-9)


def test_scores_fit_into_methods_that_the_jvm_compiles(spark, fit):
    """Beyond 8,000 bytes a method stays interpreted, some fifty times slower."""
    table, models, beta = fit
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scored = weights.interval_weights(table, models, weights.coefficients(spark, models, beta), F.col("int") == 1)
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            scored.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) <= 8000


def test_probabilities_are_those_of_the_expressions(spark, fit):
    """Also with missing terms, levels that are not listed and rows of no stratum."""
    table, models, beta = fit
    coefs = weights.coefficients(spark, models, beta)
    odd = table.withColumns({
        "race": F.when(F.col("int") == 2, None).otherwise(F.col("race")), "sex": F.when(F.col("bene_id") == "p5", "X").otherwise(F.col("sex")),
        "age_start": F.when(F.col("bene_id") == "p8", None).otherwise(F.col("age_start")), "exposed": F.when(F.col("bene_id") != "p9", F.col("exposed")),
    })
    plain = odd.join(coefs, "exposed").select("bene_id", "int", *[glm.fitted(m.terms, F.col(f"beta_{m.name}")).alias(m.name) for m in models])
    made = weights.with_probabilities(odd, models, coefs).select("bene_id", "int", "_p.*")
    a, b = ({(r["bene_id"], r["int"]): r[2:] for r in df.collect()} for df in (made, plain))
    assert a.keys() == b.keys() and len(a) == 2997
    for k, row in a.items():
        for x, y in zip(row, b[k], strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-12)


def test_rows_are_unpacked_once_not_in_every_pass(spark, monkeypatch, tmp_path):
    """Passes read packed blocks; the rows themselves reach Python once."""
    table = written(people(spark).withColumn("freq", F.lit(1)).coalesce(1), "one-file")
    model = glm.Logit("m", "screen", (glm.Numeric("screen_1"), glm.Category("race", (1, 2, 3))), by=("exposed",))
    plain, plain_products = glm.chunks, glm._cross_products

    def noted(batches, *more):
        for rows in plain(batches, *more):
            open(os.path.join(tmp_path, f"rows-{os.urandom(8).hex()}-{len(rows)}"), "w").close()
            yield rows

    def product(*given):
        open(os.path.join(tmp_path, f"products-{os.urandom(8).hex()}"), "w").close()
        return plain_products(*given)

    monkeypatch.setattr(glm, "chunks", noted)
    monkeypatch.setattr(glm, "_cross_products", product)
    fits = glm.fit_logits(table, [model])
    names = os.listdir(tmp_path)
    assert set(fits) == {("m", 0), ("m", 1)}
    assert sum(n.startswith("products") for n in names) >= 6
    assert sum(int(n.split("-")[2]) for n in names if n.startswith("rows")) == 3000


@pytest.mark.parametrize("values", [[1, 0, 1], [-1, 200], [2**40, -3], [0.5, None, 3.25], [1, None], [True, False], [b"\x00\x01", b"\x00\x00"], [-(2**63), 2**63 - 1]])
def test_packed_numbers_are_those_given(values):
    rows = pa.RecordBatch.from_arrays([pa.array(values)], ["c"]).to_pandas()
    batch = pa.RecordBatch.from_arrays([pa.array([[4]]), pa.array([glm._packed(rows["c"])])], [glm.GROUP, "c"])
    [(group, back)] = glm._unpacked([batch])
    assert group == [4] and [None if v != v else v for v in back["c"].tolist()] == values


@pytest.mark.parametrize("size", [1, 3])
def test_products_by_cell_are_those_of_the_rows(size):
    """Categories and numbers of few values come in once a cell, wherever they stand in the model; missing terms too."""
    rng = np.random.default_rng(7)
    n = 400
    rows = pd.DataFrame({
        "age": rng.uniform(50, 60, n), "flag": rng.integers(0, 2, n).astype(float), "sum": rng.integers(0, 90, n),
        "race__code": rng.choice([0.0, 1.0, 2.0, np.nan], n), "sex__code": rng.integers(0, 2, n), "y": rng.integers(0, 2, n),
    })
    terms = (glm.Numeric("flag"), glm.Category("race", (1, 2, 3)), glm.Spline("age", 50, 60), glm.Category("sex", ("F", "M")), glm.Numeric("sum"))
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)

    class Table:
        columns = list(rows)

        def mapInArrow(self, pack, kind):
            return glm._unpacked(pack(iter([batch])))

    [(_, part)] = glm._blocks(Table(), (), size, terms)
    assert sorted(part["age"]) == sorted(rows["age"])
    x = glm._Cells(part).design(terms)
    known = x.known()
    assert x.shared.shape == (5, 16) and x.own.shape == (4, n) and known.sum() == rows["race__code"].notna().sum()
    y, freq, beta = part["y"].to_numpy(float), rng.integers(0, 4, (n, size)), rng.normal(size=(size, 9)) / 9
    dense = glm._design(part, terms)
    for kept in (known, known & (part["sex__code"].to_numpy() == 1), np.zeros(n, bool)):
        found = glm._cross_products(x[kept], y[kept], freq[kept], beta)
        assert np.allclose(found, glm._cross_products(dense[kept], y[kept], freq[kept], beta), rtol=1e-9)
        assert x[kept].shared.shape[1] <= 12


def test_fits_take_products_by_cell(spark, monkeypatch, tmp_path):
    """The products of a model's categories follow the patterns that occur, not the rows."""
    table = written(people(spark).withColumn("freq", F.lit(1)).coalesce(1), "one-file")
    model = glm.Logit("m", "screen", (glm.Numeric("screen_1"), glm.Spline("age_start", 50, 62), glm.Category("race", (1, 2, 3)), glm.Category("sex", ("F", "M"))))
    plain = glm._cross_products

    def noted(x, y, freq, beta):
        open(os.path.join(tmp_path, f"{os.urandom(8).hex()}-{len(x)}-{getattr(x, 'shared', np.empty((0, len(x)))).shape[1]}"), "w").close()
        return plain(x, y, freq, beta)

    monkeypatch.setattr(glm, "_cross_products", noted)
    glm.fit_logits(table, [model])
    seen = {tuple(map(int, name.split("-")[1:])) for name in os.listdir(tmp_path)}
    assert seen == {(3000, 12)}
