"""Shared SQL of the checks: derived inputs, cohort, panel and protocol as CTEs.

The SQL follows the plain, row-by-row definition of every step (windows, joins,
recursion), not the way the library computes it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from riskline.sources.derived import CUTOFF, PERIODS, PROCEDURE_SQL, SUBJECT_SQL, WINDOW_FROM
from riskline.sources.schema import CONDITIONS

CUT = f"DATE '{CUTOFF}'"


def addm(d: str, n) -> str:
    return f"CAST({d} + to_months(CAST({n} AS INTEGER)) AS DATE)"


def strict(d: str, n) -> str:
    return f"CASE WHEN day({addm(d, n)}) = day({d}) THEN {addm(d, n)} END"


def whole(a: str, b: str, m: int) -> str:
    k = f"CAST(floor(((year({b})-year({a}))*12 + month({b})-month({a}))/{m}.0) AS INTEGER)"
    return f"({k} - CASE WHEN {addm(a, f'{m}*{k}')} > {b} THEN 1 ELSE 0 END)"


def div(a: str, b: str, m: int) -> str:
    n = whole(a, b, m)
    lo, hi = addm(a, f"{m}*{n}"), addm(a, f"{m}*({n}+1)")
    return f"({n} + CAST({b} - {lo} AS DOUBLE) / ({hi} - {lo}))"


def uniform(seed, *parts: str) -> str:
    text = f"concat_ws(':', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})"
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


@dataclass(frozen=True)
class Setup:
    """Parameters of one study variant in SQL."""

    years: float = 1.0
    types: str = "proc_type <> 3"
    window: bool = False
    preserve: bool = False
    every: float = 2.0
    tol: float = 0.25


def thinning(name: str, source: str, years: float) -> dict[str, str]:
    """CTEs ``<name>`` with the kept rows of ``source`` (bene_id, proc_date, proc_type)."""
    return {
        f"{name}_day": f"SELECT bene_id, proc_date, min(proc_type) AS proc_type FROM {source} GROUP BY bene_id, proc_date",
        f"{name}_prev": f"""SELECT *, row_number() OVER (PARTITION BY bene_id ORDER BY proc_date) AS rn,
            lag(proc_date) OVER (PARTITION BY bene_id ORDER BY proc_date) AS prev FROM {name}_day""",
        f"{name}_gap": f"SELECT *, coalesce({div('prev', 'proc_date', 12)}, 0.0) AS gap FROM {name}_prev",
        f"{name}_fold": f"""SELECT bene_id, rn, proc_date, proc_type, CAST(0.0 AS DOUBLE) AS since, TRUE AS keep
            FROM {name}_gap WHERE rn = 1
            UNION ALL
            SELECT g.bene_id, g.rn, g.proc_date, g.proc_type,
              CASE WHEN f.since + g.gap > {years} THEN 0.0 ELSE f.since + g.gap END, f.since + g.gap > {years}
            FROM {name}_fold f JOIN {name}_gap g ON g.bene_id = f.bene_id AND g.rn = f.rn + 1""",
        name: f"SELECT bene_id, proc_date, proc_type FROM {name}_fold WHERE keep",
    }


def ctes(s: Setup) -> dict[str, str]:
    c: dict[str, str] = {}
    c["first_order"] = "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS st FROM orders GROUP BY o_custkey"
    c["subject"] = f"SELECT {', '.join(SUBJECT_SQL)} FROM customer JOIN first_order ON o_custkey = c_custkey"
    c["procedure_all"] = f"SELECT {', '.join(PROCEDURE_SQL)} FROM orders"
    c["procs"] = f"SELECT * FROM procedure_all WHERE {s.types}"
    c["s1"] = f"""SELECT * REPLACE (CASE WHEN month(dob) = 2 AND day(dob) = 29 THEN dob - 1 ELSE dob END AS dob),
        {strict('start_date', 6)} AS b0 FROM subject"""
    c["s2"] = f"SELECT *, {addm('dob', 600)} AS min_age_date FROM s1"
    c["s3"] = f"""SELECT * REPLACE (CASE WHEN end_date > {CUT} THEN {CUT} ELSE end_date END AS end_date),
        CASE WHEN min_age_date > b0 THEN min_age_date ELSE b0 END AS baseline FROM s2"""
    c["elig"] = """SELECT *, CASE WHEN exposure_date IS NULL THEN 0 WHEN exposure_date <= baseline THEN 1 ELSE 0 END AS exposed
        FROM s3 WHERE (dod IS NULL OR dod > baseline) AND (any_date_type1 IS NULL OR any_date_type1 > baseline)
        AND end_date > baseline"""
    c["ev0"] = "SELECT *, least(end_date, primary_date, any_date_type2, dod) AS event_date FROM elig"
    c["ev1"] = """SELECT *, CASE WHEN event_date = primary_date THEN 'primary' WHEN event_date = dod THEN 'competing'
        ELSE 'censor' END AS kind FROM ev0"""
    start = f"DATE '{WINDOW_FROM}'"
    c["ev"] = (
        f"""SELECT * REPLACE (CASE WHEN baseline > {start} THEN baseline ELSE {start} END AS baseline)
        FROM ev1 WHERE event_date > {start}"""
        if s.window
        else "SELECT * FROM ev1"
    )
    c["co0"] = f"""SELECT *, CASE WHEN kind = 'primary' AND coalesce(exclusion_date - primary_date BETWEEN 0 AND 60, FALSE)
        THEN 'censor' ELSE kind END AS first_event, floor({div('dob', 'baseline', 12)}) AS age_base,
        year(baseline) AS yr_base, {div('baseline', 'event_date', 3)} AS event_time FROM ev"""
    c["cohort"] = """SELECT *, CAST(CASE WHEN event_time = floor(event_time) THEN event_time + 1 ELSE ceil(event_time) END AS BIGINT)
        AS event_int FROM co0 WHERE event_time >= 0"""
    c["onsets"] = "SELECT *, " + ", ".join(
        f"ceil({div('baseline', f'cond_{k}_date', 3)}) AS onset_{k}" for k in CONDITIONS
    ) + " FROM cohort"
    c["enrolled"] = """SELECT p.bene_id, p.proc_date, p.proc_type, c.min_age_date
        FROM procs p JOIN cohort c ON c.bene_id = p.bene_id WHERE p.proc_date <= c.end_date"""
    c["prior"] = "SELECT bene_id FROM enrolled GROUP BY bene_id HAVING min(proc_date) < min(min_age_date)"
    c["unprior"] = "SELECT bene_id, proc_date, proc_type FROM enrolled WHERE bene_id NOT IN (SELECT bene_id FROM prior)"
    c["clean"] = "SELECT bene_id, proc_date, min(proc_type) AS proc_type FROM unprior GROUP BY bene_id, proc_date"
    c.update(thinning("kept", "clean", s.years))
    c["kept0"] = f"""SELECT k.*, c.baseline, lag(proc_date) OVER (PARTITION BY k.bene_id ORDER BY proc_date) AS prev
        FROM kept k JOIN cohort c ON c.bene_id = k.bene_id"""
    c["kept1"] = f"""SELECT *, {div('baseline', 'proc_date', 3)} AS proc_time, {div('prev', 'proc_date', 12)} AS t_between FROM kept0"""
    c["kept2"] = """SELECT *, CAST(CASE WHEN proc_time = floor(proc_time) THEN proc_time + 1 ELSE ceil(proc_time) END AS BIGINT) AS int
        FROM kept1"""
    c["b0"] = "SELECT *, unnest(range(1, event_int + 1)) AS int FROM onsets"
    c["b1"] = f"""SELECT *, coalesce({strict('baseline', '(int-1)*3')},
        baseline + CAST(floor((int-1)*3*30.4375) AS INTEGER)) AS int_start FROM b0"""
    c["b2"] = f"SELECT *, {div('dob', 'int_start', 12)} AS age_start FROM b1"
    c["b3"] = """SELECT *, lead(int_start) OVER w AS next_start, lead(age_start) OVER w AS next_age FROM b2
        WINDOW w AS (PARTITION BY bene_id ORDER BY int)"""
    c["b4"] = "SELECT *, CASE WHEN next_start IS NULL THEN event_date ELSE next_start - 1 END AS int_end FROM b3"
    c["b5"] = f"SELECT *, CASE WHEN next_age IS NULL THEN {div('dob', 'int_end', 12)} ELSE next_age END AS age_end FROM b4"
    if s.preserve:
        c["b6"] = """SELECT * REPLACE (CAST(event_int - max(CASE WHEN int = event_int AND age_start >= age_end THEN 1 ELSE 0 END)
            OVER (PARTITION BY bene_id) AS BIGINT) AS event_int) FROM b5"""
        c["b7"] = f"""SELECT * REPLACE (CASE WHEN int = event_int THEN event_date ELSE int_end END AS int_end,
            CASE WHEN int = event_int THEN {div('dob', 'event_date', 12)} ELSE age_end END AS age_end)
            FROM b6 WHERE int <= event_int"""
    else:
        c["b6"] = """SELECT * REPLACE (CASE WHEN int = event_int AND age_start >= age_end THEN event_int - 1 ELSE event_int END
            AS event_int) FROM b5"""
        c["b7"] = "SELECT * FROM b6 WHERE int <= event_int"
    flags = " + ".join(f"CASE WHEN int >= onset_{k} THEN 1 ELSE 0 END" for k in CONDITIONS)
    c["b8"] = f"SELECT *, {flags} AS n_cond, 0 AS drop FROM b7"
    c["dropped"] = f"""SELECT * REPLACE (int + 1 AS int, int_end AS int_start, age_end AS age_start, int_end + 1 AS int_end,
        {div('dob', '(int_end + 1)', 12)} AS age_end, 1 AS drop)
        FROM b8 WHERE int = event_int AND first_event = 'censor' AND int_end < {CUT}
        AND int_end < {strict(addm('dob', 780), -1)}"""
    c["b9"] = "SELECT * FROM b8 UNION ALL SELECT * FROM dropped"
    c["j1"] = """SELECT b.*, k.proc_type, k.proc_date, k.proc_time, CASE WHEN k.bene_id IS NULL THEN 0 ELSE 1 END AS proc
        FROM b9 b LEFT JOIN kept2 k ON k.bene_id = b.bene_id AND k.int = b.int
        WHERE b.bene_id NOT IN (SELECT bene_id FROM prior)"""
    c["j2"] = """SELECT *, last_value(proc_date IGNORE NULLS) OVER (PARTITION BY bene_id ORDER BY int, proc_date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM j1"""
    c["j3"] = """SELECT *, CASE WHEN proc = 1 THEN lag(carried) OVER (PARTITION BY bene_id ORDER BY int, proc_date) ELSE carried END
        AS date_last_proc FROM j2"""
    c["panel"] = f"""SELECT *, CASE WHEN date_last_proc IS NULL AND proc = 0 THEN {div('baseline', 'int_end', 12)}
        WHEN date_last_proc IS NULL THEN {div('baseline', 'proc_date', 12)}
        WHEN proc = 0 THEN {div('date_last_proc', 'int_end', 12)}
        ELSE {div('date_last_proc', 'proc_date', 12)} END AS years_since_proc,
        CASE WHEN date_last_proc IS NULL THEN 0 ELSE 1 END AS prior_proc FROM j3"""
    (a1, a2), (b1, b2) = PERIODS
    period = f"CASE WHEN yr_base BETWEEN {a1} AND {a2} THEN 1 WHEN yr_base BETWEEN {b1} AND {b2} THEN 2 ELSE 3 END"
    c["r1"] = f"""SELECT * REPLACE (CASE WHEN n_cond > 1 THEN 2 ELSE n_cond END AS n_cond), {period} AS enroll_period,
        CASE WHEN years_since_proc > {s.every + s.tol} THEN 0
          WHEN proc = 1 AND prior_proc = 1 AND years_since_proc < {s.every - s.tol} THEN 0 ELSE 1 END AS screen,
        CASE WHEN int <> event_int THEN 0 WHEN first_event = 'censor' THEN 0 WHEN first_event = 'primary' THEN 1
          ELSE 2 END AS event FROM panel WHERE race IS NOT NULL AND sex IS NOT NULL"""
    lags = """coalesce(lag(n_cond) OVER w, n_cond) AS n_cond_1,
        coalesce(lag(n_cond, 2) OVER w, lag(n_cond) OVER w, n_cond) AS n_cond_2,
        lag(screen, 1, 1) OVER w AS screen_1, lag(screen, 2, 1) OVER w AS screen_2,
        CAST(product(screen) OVER w AS BIGINT) AS cum_screen"""
    c["rows"] = f"SELECT *, {lags} FROM r1 WINDOW w AS (PARTITION BY bene_id ORDER BY int)"
    c["base"] = "SELECT * FROM rows WHERE int = 1"
    c["y0"] = """SELECT bene_id, CAST(floor(age_start) AS BIGINT) + 1 AS age, any_value(race) AS race, any_value(sex) AS sex,
        any_value(first_elig_state) AS first_elig_state, any_value(exposed) AS exposed, any_value(yr_base) AS yr_base,
        max(n_cond) AS n_cond, max(proc) AS proc,
        max(CASE WHEN int <> event_int THEN 0 WHEN first_event = 'primary' THEN 1 WHEN first_event = 'competing' THEN 3
          WHEN event_date = any_date_type2 THEN 2 ELSE 0 END) AS event
        FROM panel WHERE drop = 0 GROUP BY bene_id, CAST(floor(age_start) AS BIGINT) + 1"""
    c["y1"] = f"""SELECT * REPLACE (CASE WHEN n_cond > 1 THEN 2 ELSE n_cond END AS n_cond), {period} AS enroll_period,
        sum(proc) OVER (PARTITION BY bene_id ORDER BY age) AS cum_proc
        FROM y0 WHERE race IS NOT NULL AND sex IS NOT NULL"""
    c["y2"] = """SELECT *, CASE WHEN age < 50 AND cum_proc > 0 THEN 0 WHEN age >= 50 AND age < 60 AND cum_proc > 1 THEN 0
        WHEN age = 60 AND cum_proc = 0 THEN 0 WHEN age > 60 AND cum_proc > 2 THEN 0 ELSE 1 END AS screen FROM y1"""
    c["years"] = f"SELECT *, {lags} FROM y2 WINDOW w AS (PARTITION BY bene_id ORDER BY age)"
    return c


def curve_ctes(name: str, source: str, by: str, start: str, stop: str, weight: str, causes: dict[str, int]) -> dict[str, str]:
    """CTE ``name`` with the cumulative incidence of ``source`` at its event times, by a risk-set join."""
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"r.{k} = t.{k}" for k in keys)
    counts = ", ".join(f"sum(CASE WHEN event = {v} THEN w ELSE 0 END) AS n_{k}" for k, v in causes.items())
    some = " OR ".join(f"n_{k} > 0" for k in causes)
    hazard = " + ".join(f"n_{k}" for k in causes)
    risks = ", ".join(f"sum(before * n_{k} / n_risk) OVER w AS risk_{k}" for k in causes)
    return {
        f"{name}_r": f"SELECT {by}, {start} AS a, {stop} AS b, event, {weight} AS w FROM {source} WHERE {start} < {stop}",
        f"{name}_t": f"SELECT * FROM (SELECT {by}, b AS time, {counts} FROM {name}_r GROUP BY {by}, b) WHERE {some}",
        f"{name}_n": f"""SELECT {', '.join('t.' + k for k in keys)}, t.time, {', '.join(f'any_value(t.n_{k}) AS n_{k}' for k in causes)},
            sum(r.w) AS n_risk FROM {name}_t t JOIN {name}_r r ON {same} AND r.a < t.time AND t.time <= r.b
            GROUP BY {', '.join('t.' + k for k in keys)}, t.time""",
        f"{name}_s": f"""SELECT *, product(1 - least(({hazard}) / n_risk, 1.0)) OVER (PARTITION BY {by} ORDER BY time) AS surv
            FROM {name}_n""",
        f"{name}_p": f"SELECT *, lag(surv, 1, 1.0) OVER (PARTITION BY {by} ORDER BY time) AS before FROM {name}_s",
        name: f"SELECT *, {risks} FROM {name}_p WINDOW w AS (PARTITION BY {by} ORDER BY time)",
    }


def assemble(select: str, parts: dict[str, str]) -> str:
    """``select`` with just the CTEs it needs."""
    needed: set[str] = set()

    def visit(text: str, own: str = "") -> None:
        for word in set(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in parts and word not in needed and word != own:
                needed.add(word)
                visit(parts[word], word)

    visit(select)
    body = ",\n".join(f"{n} AS ({t})" for n, t in parts.items() if n in needed)
    return f"WITH RECURSIVE {body}\n{select}" if body else select


def cols(spec: str, prefix: str = "") -> str:
    """Output columns: ``name:kind`` with i integer, x and w double, d date, s text."""
    cast = {
        "i": "CAST({0} AS BIGINT)",
        "x": "round(CAST({0} AS DOUBLE), 6) + 0.0",
        "w": "round(CAST({0} AS DOUBLE), 3) + 0.0",
        "d": "CAST({0} AS VARCHAR)",
        "s": "{0}",
    }
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        out.append(f"{cast[kind].format(prefix + name)} AS {name}")
    return ", ".join(out)
