"""Hand-made cases with results worked out by hand, and brute-force checks."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskline.functions import calendar as cal
from riskline.functions import sequence as seq
from riskline.operators import cohort as co
from riskline.operators import events as ev
from riskline.operators import panel as pn
from riskline.operators import protocol as pr
from riskline.operators import quantiles, sampling, summary, survival, weights
from riskline.sources.schema import CONDITIONS

D = dt.date
CUT = D(2015, 9, 30)


def person(spark, **values):
    base = {
        "bene_id": "A", "race": 1, "sex": "F", "first_elig_state": "x", "start_date": D(1995, 7, 15), "end_date": D(2000, 1, 1),
        "dob": D(1946, 1, 15), "dod": None, "exposure_date": None, "any_date_type1": None, "any_date_type2": None,
        "primary_date": None, "exclusion_date": None, **{f"cond_{c}_date": None for c in CONDITIONS},
    }
    base.update(values)
    from riskline.sources.schema import SUBJECT

    return spark.createDataFrame([tuple(base[n] for n in SUBJECT.names)], SUBJECT)


def visits(spark, rows):
    return spark.createDataFrame(rows, "bene_id string, proc_date date, proc_type int")


def panel_of(spark, subject, procs=(), **kw):
    p = visits(spark, list(procs))
    cohort = co.build_cohort(subject, CUT)
    return pn.build_panel(cohort, p, CUT, **kw).orderBy("int").collect()


def test_leap_birthday(spark):
    row = co.with_baseline(person(spark, dob=D(1948, 2, 29)), CUT).first()
    assert row["dob"] == D(1948, 2, 28) and row["min_age_date"] == D(1998, 2, 28)


def test_missing_wash_in_day_drops_person(spark):
    df = co.with_baseline(person(spark, start_date=D(1995, 8, 31)), CUT)
    assert df.first()["baseline"] is None
    assert co.eligible(df).count() == 0


def test_interval_starts_fall_back_to_durations(spark):
    subject = person(spark, start_date=D(1995, 5, 30), dob=D(1930, 1, 1), end_date=D(1996, 6, 15))
    subject = subject.withColumn("start_date", F.lit(D(1995, 5, 30)))
    rows = panel_of(spark, subject)
    # baseline 1995-11-30; 1996-02-30 does not exist
    assert [r["int_start"] for r in rows][:3] == [D(1995, 11, 30), D(1996, 2, 29), D(1996, 5, 30)]
    assert rows[0]["event_time"] == pytest.approx(2.173913, abs=1e-6) and rows[0]["event_int"] == 3


def test_event_on_boundary_is_lost_by_default(spark):
    subject = person(spark, dod=D(1996, 7, 15))
    rows = panel_of(spark, subject)
    assert [r["int"] for r in rows] == [1, 2]
    assert {r["event_int"] for r in rows} == {3} and rows[0]["event_time"] == 2.0
    assert [round(r["age_start"], 6) for r in rows] == [50.0, 50.248634]
    assert round(rows[1]["age_end"], 6) == 50.497268
    kept = panel_of(spark, subject, preserve_boundary_event=True)
    assert {r["event_int"] for r in kept} == {2} and kept[-1]["int_end"] == D(1996, 7, 15)


def test_thinning_example(spark):
    days = [D(2000, 1, 1), D(2000, 6, 1), D(2000, 12, 20), D(2001, 3, 1), D(2002, 2, 1), D(2002, 4, 1)]
    df = visits(spark, [("A", d, 1) for d in days])
    got = lambda w: sorted(r["proc_date"] for r in ev.thin_events(df, years=w).collect())
    assert got(1.0) == [D(2000, 1, 1), D(2001, 3, 1), D(2002, 4, 1)]
    assert got(0.5) == [D(2000, 1, 1), D(2000, 12, 20), D(2002, 2, 1)]


def test_thinning_against_brute_force_with_a_hot_person(spark):
    rng = random.Random(7)
    rows = [("hot", D(1990, 1, 1) + dt.timedelta(days=rng.randrange(9000)), rng.randrange(1, 6)) for _ in range(4000)]
    for i in range(60):
        rows += [(f"P{i}", D(1990, 1, 1) + dt.timedelta(days=rng.randrange(4000)), 1) for _ in range(rng.randrange(1, 30))]

    def whole(a, b):
        n = b.year - a.year
        return n - ((b.month, b.day) < (a.month, a.day))

    def years(a, b):
        n = whole(a, b)

        def plus(k):
            try:
                return a.replace(year=a.year + k)
            except ValueError:
                return a.replace(year=a.year + k, day=28)

        if plus(n + 1) <= b:
            n += 1
        return n + (b - plus(n)).days / (plus(n + 1) - plus(n)).days

    want = set()
    for who in {r[0] for r in rows}:
        days = sorted({r[1] for r in rows if r[0] == who})
        since = 0.0
        for i, d in enumerate(days):
            if i:
                since += years(days[i - 1], d)
            if i == 0 or since > 1.0:
                want.add((who, d))
                since = 0.0
    got = {(r["bene_id"], r["proc_date"]) for r in ev.thin_events(visits(spark, rows)).collect()}
    assert got == want


def test_event_ties_and_exclusion(spark):
    day = D(1998, 3, 1)
    tie = co.with_first_event(co.with_baseline(person(spark, end_date=day, dod=day, primary_date=day), CUT)).first()
    assert tie["first_event"] == "primary"
    for gap, want in ((0, "censor"), (60, "censor"), (61, "primary"), (-1, "primary")):
        df = person(spark, primary_date=day, exclusion_date=day + dt.timedelta(days=gap))
        got = co.exclude_if_within(co.with_first_event(co.with_baseline(df, CUT))).first()
        assert got["first_event"] == want, gap


def test_history_is_carried_and_excludes_the_interval_itself(spark):
    subject = person(spark, end_date=D(1997, 7, 1))
    first, second = D(1996, 5, 1), D(1997, 6, 1)
    rows = panel_of(spark, subject, [("A", first, 1), ("A", second, 1)])[:6]
    assert [r["proc"] for r in rows] == [0, 1, 0, 0, 0, 1]
    assert [r["prior_proc"] for r in rows] == [0, 0, 1, 1, 1, 1]
    assert [r["date_last_proc"] for r in rows] == [None, None, first, first, first, first]


def test_condition_onset(spark):
    base = D(1996, 1, 15)
    subject = person(spark, cond_01_date=D(1996, 4, 15), cond_02_date=D(1995, 12, 1), cond_03_date=D(1996, 5, 1))
    row = co.with_condition_onsets(co.build_cohort(subject, CUT)).first()
    assert row["baseline"] == base
    assert (row["onset_01"], row["onset_02"], row["onset_03"], row["onset_04"]) == (1, 0, 2, None)
    assert [r["n_cond"] for r in panel_of(spark, subject)][:3] == [2, 3, 3]


TOY = [(50.0, 52.0, 1), (50.0, 53.0, 2), (50.0, 54.0, 0), (51.0, 55.0, 1)]


def toy(spark, rows=TOY):
    return spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], "bene_id int, exposed int, a double, b double, event int")


def test_incidence_toy(spark):
    got = survival.cumulative_incidence(toy(spark), ["exposed"], "a", "b").orderBy("time").collect()
    assert [(r["time"], r["surv"], r["risk_primary"], r["risk_competing"]) for r in got] == [
        (50.0, 1.0, 0.0, 0.0), (52.0, 0.75, 0.25, 0.0), (53.0, 0.5, 0.25, 0.25), (55.0, 0.0, 0.75, 0.25),
    ]


def test_adherence_limits(spark):
    rows = [(10.25, 0, 0), (10.26, 0, 0), (9.74, 1, 1), (9.75, 1, 1), (9.74, 1, 0)]
    df = spark.createDataFrame(rows, "years_since_proc double, proc int, prior_proc int")
    assert [r[0] for r in df.select(pr.adherent(10)).collect()] == [1, 0, 0, 1, 1]


def test_adherence_history(spark):
    df = spark.createDataFrame([("A", i, s) for i, s in enumerate((1, 1, 0, 1))], "bene_id string, int int, screen int")
    got = pr.with_screen_history(df).orderBy("int").collect()
    assert [r["cum_screen"] for r in got] == [1, 1, 0, 0]
    assert [r["screen_1"] for r in got] == [1, 1, 1, 0]
    assert [r["screen_2"] for r in got] == [1, 1, 1, 1]


def test_through_first_deviation(spark):
    df = spark.createDataFrame([("A", i, d) for i, d in enumerate((0, 0, 1, 0, 1))], "bene_id string, int int, dev int")
    got = df.withColumn("k", seq.through_first(F.col("dev"), seq.by_person("int"))).orderBy("int").collect()
    assert [r["k"] for r in got] == [True, True, True, False, False]


def test_alignment(spark):
    rows = [(0, 50.0, 0.0, 0.0), (0, 52.0, 0.2, 0.1), (0, 54.0, 0.3, 0.1), (1, 50.0, 0.0, 0.0), (1, 53.0, 0.4, 0.2), (1, 54.0, 0.5, 0.2)]
    curve = spark.createDataFrame(rows, "exposed int, time double, risk_primary double, risk_competing double")
    left = survival.align_curves(curve, mode="exact_left").orderBy("time").collect()
    assert [(r["time"], r["risk_primary1"]) for r in left] == [(50.0, 0.0), (52.0, 0.0), (54.0, 0.5)]
    both = survival.align_curves(curve).orderBy("time").collect()
    assert [(r["time"], r["risk_primary0"], r["risk_primary1"]) for r in both] == [
        (50.0, 0.0, 0.0), (52.0, 0.2, 0.0), (53.0, 0.2, 0.4), (54.0, 0.3, 0.5),
    ]


def test_truncation(spark):
    df = spark.createDataFrame([(0, 50.0, w) for w in (1.0, 150.0, 3.0)], "rep int, age_start double, wt_final double")
    df = df.withColumn("cum_screen", F.lit(1))
    summ = weights.weight_summary(df)
    assert summ.first()["p95_wt"] == pytest.approx(135.3)
    got = sorted(r["wt_final"] for r in weights.truncate_weight(df, summ).collect())
    assert got == pytest.approx([1.0, 3.0, 135.3])


def test_calendar_matches_day_counting(spark):
    rng = random.Random(3)
    pairs = [(D(1940, 1, 1) + dt.timedelta(days=rng.randrange(9000)), D(1960, 1, 1) + dt.timedelta(days=rng.randrange(9000))) for _ in range(400)]
    pairs += [(D(2000, 2, 29), D(2001, 2, 28)), (D(2000, 1, 31), D(2000, 2, 29)), (D(2000, 1, 31), D(2000, 3, 30))]
    df = spark.createDataFrame(pairs, "a date, b date")
    for m in (1, 3, 12):
        got = df.select("a", "b", cal.whole_periods(F.col("a"), F.col("b"), m).alias("n"),
                        cal.calendar_div(F.col("a"), F.col("b"), m).alias("x")).collect()
        for r in got:
            k = 0
            add = lambda n: _clamped(r["a"], n * m)
            while add(k + 1) <= r["b"]:
                k += 1
            while add(k) > r["b"]:
                k -= 1
            assert r["n"] == k
            assert r["x"] == pytest.approx(k + (r["b"] - add(k)).days / (add(k + 1) - add(k)).days)


def _clamped(day, months):
    total = day.year * 12 + day.month - 1 + months
    y, m = divmod(total, 12)
    last = (D(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return D(y, m + 1, min(day.day, last))


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 1, 4000), -rng.lognormal(0, 2, 3000), np.zeros(500), np.full(900, 1.0), 1 + rng.random(500) * 1e-9])
    small = [3.0, 1.0, 2.0]
    rows = [("big", float(v), 1) for v in values] + [("small", v, 2) for v in small] + [("small", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, f int")
    probs = (0.0, 0.025, 0.05, 0.5, 0.77, 0.95, 1.0)
    names = [f"q{i}" for i in range(len(probs))]
    got = {r["k"]: [r[n] for n in names] for r in quantiles.exact_quantiles(df, ["k"], "v", probs, names, F.col("f")).collect()}
    assert got["big"] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=1e-12)
    assert got["small"] == pytest.approx(list(np.quantile(small * 2, probs)))


def test_robust_errors_against_leaving_weight_on_people(spark):
    """Squared influences equal those from perturbing each person's weight."""
    rng = random.Random(11)
    rows = []
    for i in range(30):
        start = 50 + rng.randrange(8) / 4
        for _ in range(rng.randrange(1, 4)):
            stop = start + rng.randrange(1, 6) / 4
            rows.append([i, 0, start, stop, 0, 1.0 + rng.randrange(3) / 2])
            start = stop + (rng.randrange(3) == 0) * 0.25
        rows[-1][4] = rng.randrange(3)
    df = spark.createDataFrame([tuple(r) for r in rows], "bene_id int, exposed int, a double, b double, event int, w double")
    got = survival.robust_incidence(df, start="a", stop="b", weight=F.col("w")).orderBy("time").collect()
    times = sorted({r[3] for r in rows if r[4] > 0})

    def curve(scale):
        s, f1, f2, out = 1.0, 0.0, 0.0, {}
        for t in times:
            y = sum(r[5] * scale.get(r[0], 1) for r in rows if r[2] < t <= r[3])
            d1 = sum(r[5] * scale.get(r[0], 1) for r in rows if r[3] == t and r[4] == 1)
            d2 = sum(r[5] * scale.get(r[0], 1) for r in rows if r[3] == t and r[4] == 2)
            f1, f2, s = f1 + s * d1 / y, f2 + s * d2 / y, s * (1 - (d1 + d2) / y)
            out[t] = (f1, f2)
        return out

    h = 1e-5
    for k, name in enumerate(("primary", "competing")):
        var = {t: 0.0 for t in times}
        for i in range(30):
            up, down = curve({i: 1 + h}), curve({i: 1 - h})
            for t in times:
                var[t] += ((up[t][k] - down[t][k]) / (2 * h)) ** 2
        for r in got:
            assert r[f"se_{name}"] == pytest.approx(var[r["time"]] ** 0.5, abs=1e-7)


def test_multinomial_resample_keeps_the_size(spark):
    ids = spark.range(500).select(F.concat(F.lit("P"), F.col("id")).alias("bene_id"))
    got = sampling.multinomial_counts(ids, 3).groupBy("rep").agg(F.sum("mult").alias("n"), F.max("mult").alias("m")).collect()
    assert {r["rep"]: r["n"] for r in got} == {0: 500, 1: 500, 2: 500, 3: 500}
    idx = sorted(r["idx"] for r in sampling.dense_index(ids).collect())
    assert idx == list(range(500))


def test_poisson_counts_look_poisson_and_ignore_order(spark):
    ids = spark.range(4000).select(F.concat(F.lit("P"), F.col("id")).alias("bene_id"))
    a = sampling.with_poisson_counts(ids, 5)
    stats = a.where("rep > 0").agg(F.sum("mult").alias("s"), F.sum(F.col("mult") * F.col("mult")).alias("q")).first()
    assert stats["s"] / 20000 == pytest.approx(1.0, abs=0.03)
    assert stats["q"] / 20000 == pytest.approx(2.0, abs=0.1)
    b = sampling.with_poisson_counts(ids.repartition(13), 5)
    key = lambda df: sorted((r["rep"], r["bene_id"], r["mult"]) for r in df.collect())
    assert key(a) == key(b)


def test_multiplicity_equals_physical_copies(spark):
    df = toy(spark, TOY * 6).withColumn("bene_id", F.col("bene_id").cast("string"))
    copies = sampling.with_poisson_counts(df, 3)
    by = ["rep", "exposed"]
    one = survival.cumulative_incidence(copies, by, "a", "b", weight=F.col("mult"))
    two = survival.cumulative_incidence(sampling.replicate_rows(copies), by, "a", "b")
    key = lambda d: sorted((r["rep"], r["time"], round(r["surv"], 9), round(r["risk_primary"], 9)) for r in d.collect())
    assert key(one) == key(two)


def test_bootstrap_grid_carries_forward(spark):
    rows = [(0, 50.0, 0.0), (0, 52.0, 0.2), (1, 50.0, 0.0), (1, 51.0, 0.1), (1, 53.0, 0.9)]
    curves = spark.createDataFrame(rows, "rep int, time double, m double")
    got = summary.on_reference_grid(curves, ["m"], 1).orderBy("rep", "time").collect()
    assert [(r["rep"], r["time"], r["m"]) for r in got] == [(0, 50.0, 0.0), (0, 52.0, 0.2), (1, 50.0, 0.0), (1, 52.0, 0.1)]


def test_crosstab_keeps_empty_cells(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1)], "x string, y int")
    got = {(r["x"], r["y"]): (r["n"], round(r["chisq"], 6)) for r in summary.crosstab_chisq(df, "x", "y").collect()}
    assert got == {("a", 0): (2, 0.333333), ("a", 1): (0, 0.666667), ("b", 0): (0, 0.666667), ("b", 1): (1, 1.333333)}


def test_several_procedures_in_an_interval(spark):
    """A row for each procedure of an interval, each with the date of the one before; other intervals carry the last."""
    from riskline.operators import panel as pn

    people = spark.sql(
        """select id as bene_id, date'2000-01-31' as baseline, date'2001-01-31' as event_date, 4 as event_int, 4 as n_int, n_drop,
        case when id = 1 then transform(array('2000-01-30', '2000-02-01', '2000-02-20', '2000-04-29', '2000-04-30', '2000-12-01', '2001-03-01'),
          d -> struct(cast(d as date) as proc_date, 1 as proc_type)) when id = 2 then array() end as procs
        from values (1, 0), (2, 1), (3, 0) as v(id, n_drop)"""
    )
    rows = pn.expand_history(people).select("bene_id", "int", F.col("proc_date").cast("string"), F.col("date_last_proc").cast("string"), "proc_type")
    got = sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1], r[2] or ""))
    assert [r[1:4] for r in got if r[0] == 1] == [
        (1, "2000-02-01", None), (1, "2000-02-20", "2000-02-01"), (1, "2000-04-29", "2000-02-20"),
        (2, "2000-04-30", "2000-04-29"), (3, None, "2000-04-30"), (4, "2000-12-01", "2000-04-30"),
    ]
    assert [r[1:] for r in got if r[0] == 2] == [(i, None, None, None) for i in range(1, 6)]
    assert [r[1:] for r in got if r[0] == 3] == [(i, None, None, None) for i in range(1, 5)]
    stops = pn.expand_history(people).where("bene_id = 2").orderBy("int").select("int_start", "stop").collect()
    assert [a["stop"] == b["int_start"] for a, b in zip(stops, stops[1:])] == [True] * 4


def test_folders_are_written_by_content(spark, tmp_path):
    """The files of a folder follow its rows."""
    import glob

    from riskline.sources import files

    df = spark.range(60_000).select(
        F.when(F.col("id") < 50, "F").otherwise("M").alias("sex"), F.md5(F.col("id").cast("string")).alias("bene_id"), F.rand(1).alias("x")
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    try:
        files.write_strata(df, str(tmp_path), ("sex",))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    count = {s: len(glob.glob(f"{tmp_path}/by_sex/sex={s}/*.parquet")) for s in "FM"}
    assert count["F"] == 1 and count["M"] > 4
    back = files.read_stratum(spark, str(tmp_path), "sex", "M", df.schema)
    assert back.count() == 59_950


def test_robust_errors_after_heavy_weights_have_left(spark):
    """Weights up to 1e13 that leave early take nothing from the errors of what stays, against exact derivatives."""
    from fractions import Fraction

    rng = random.Random(12)
    rows = []
    for i in range(40):
        heavy = i < 6
        start, w = 50 + rng.randrange(4) / 4, rng.choice([1e13, 3.3e12]) if heavy else rng.choice([0.001, 0.7, 1.0, 2.5])
        for k in range(1 if heavy else rng.randrange(2, 6)):
            stop = start + rng.randrange(1, 4) / 4
            rows.append([i, 0, start, stop, 0, w * (1 + k / 7)])
            start = stop + (rng.randrange(3) == 0) * 0.25
        rows[-1][4] = 0 if heavy else rng.randrange(3)
    df = spark.createDataFrame([tuple(r) for r in rows], "bene_id int, exposed int, a double, b double, event int, w double")
    got = {r["time"]: r for r in survival.robust_incidence(df, start="a", stop="b", weight=F.col("w")).collect()}
    times = sorted({r[3] for r in rows if r[4] > 0})
    var = {t: [0.0, 0.0] for t in times}
    for i in range(40):
        # Curves with their derivatives by the person's share, in whole fractions.
        s, ds, f, df_ = Fraction(1), Fraction(0), [Fraction(0)] * 2, [Fraction(0)] * 2
        for t in times:
            w, own = lambda some: sum((Fraction(r[5]) for r in some), Fraction(0)), lambda some: [r for r in some if r[0] == i]
            risk = [r for r in rows if r[2] < t <= r[3]]
            had = [[r for r in risk if r[3] == t and r[4] == k] for k in (1, 2)]
            y, dy = w(risk), w(own(risk))
            h = [w(x) / y for x in had]
            dh = [(w(own(x)) * y - w(x) * dy) / (y * y) for x in had]
            f, df_ = [a + s * b for a, b in zip(f, h)], [a + ds * b + s * c for a, b, c in zip(df_, h, dh)]
            s, ds = s * (1 - sum(h)), ds * (1 - sum(h)) - s * sum(dh)
            for k in (0, 1):
                var[t][k] += float(df_[k] ** 2)
    assert set(got) == set(times) and len(times) > 8
    for t in times:
        for k, name in enumerate(("primary", "competing")):
            assert got[t][f"se_{name}"] == pytest.approx(var[t][k] ** 0.5, rel=1e-9, abs=1e-14)
