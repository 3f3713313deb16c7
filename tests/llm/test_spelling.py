"""Spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskline.llm import spelling


def distance_is_one(a, b):
    made = {a[:i] + a[i + 1 :] for i in range(len(a))}
    other = {b[:i] + b[i + 1 :] for i in range(len(b))}
    same = len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return same or b in made or a in other


def plain(docs, shortest=6, least=5, one_in=199, times=5):
    n = Counter()
    for d, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance_is_one(w, v)] for w in n}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_near():
    rng = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(7))) for _ in range(2))
        assert spelling.near(a, b) == (a != b and distance_is_one(a, b))


def test_near_rows():
    """As arrays, with words on both sides of the width up to which they are."""
    rng = random.Random(6)
    found = ["".join(rng.choice("abÿ") for _ in range(rng.randrange(7))) for _ in range(150)]
    found += ["x" * k + rng.choice("ab") + "y" * (spelling.WIDE + d - k) for k in (0, 3, spelling.WIDE - 3) for d in (-2, -1, 0, 1) for _ in range(3)]
    q, w = (g.ravel() for g in np.meshgrid(np.arange(len(found)), np.arange(len(found))))
    got = spelling.near_rows(spelling.Letters(found), spelling.Letters(found[:]), q, w)
    assert got.tolist() == [spelling.near(found[i], found[j]) for i, j in zip(q, w, strict=True)]


def test_trie_finds_all():
    """A block of a cell: every pair is met, from one side or from both, and counts for both once."""
    rng = random.Random(3)
    found = sorted({"".join(rng.choice("eatlzÀÿ×") for _ in range(rng.randrange(1, 8))) for _ in range(3000)})
    n = {w: rng.randrange(1, 9) for w in found}
    kept = pa.table({"word": found, "n": [n[w] for w in found]})
    sought = pa.table({"asked": found, "n": [n[w] for w in found], "more": [1] * len(found), "less": [1] * len(found)})
    got = {}
    for r in spelling.near_words(kept, sought, 0).to_pylist():
        old = got.get(r["word"], (0, 0, ""))
        got[r["word"]] = (old[0] + r["n_near"], *min((old[1:], (r["best_n"], r["best"])), key=lambda x: (-x[0], x[1])))
    want = {}
    for w in found:
        around = [v for v in found if abs(len(v) - len(w)) < 2 and v != w and distance_is_one(w, v)]
        if around:
            best = min(around, key=lambda v: (-n[v], v))
            want[w] = (len(around), n[best], best)
    assert got == want
    assert spelling.near_words(kept.slice(0, 0), sought, 3).num_rows == spelling.near_words(kept, sought.slice(0, 0), 0).num_rows == 0


def test_ways():
    """Every reachable cell is entered once."""
    for depth in (1, 3, 5):
        steps = spelling._steps(depth)
        assert len({s for s, _, _ in steps}) == len(steps) == 1 + depth + depth * (depth - 1) // 2
        for s, more, less in steps:
            assert more == 1 - sum(x for x in s if x > 0) and less == 1 + sum(x for x in s if x < 0)
            assert -1 not in s or s.index(1) < s.index(-1)


@pytest.mark.parametrize("cell, full", [(spelling.CELL, spelling.FULL), (40, 20)])
def test_words_of_made_texts(spark, monkeypatch, cell, full):
    """Chains of forms, ties, long runs, odd rows; with small cells there are many blocks."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "FULL", full)
    rng = random.Random(4)
    base = ["".join(rng.choice("eaitnslcmé") for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    texts = []
    for w in base:
        texts += [w] * rng.choice([5, 30, 400])
        for _ in range(8):
            i, x = rng.randrange(len(w)), rng.choice("eaozÀ×")
            texts += [rng.choice([w[:i] + x + w[i:], w[:i] + x + w[i + 1 :], w[:i] + w[i + 1 :]])] * rng.choice([4, 5, 6, 29, 31, 200])
    rng.shuffle(texts)
    texts = [rng.choice([str.upper, str])(t) if t.isascii() else t for t in texts]
    docs = [(i, " ".join(texts[k : k + 50])) for i, k in enumerate(range(0, len(texts), 50))]
    docs += [(None, None), (7, ""), (None, "zzzzzzzĀzzzzzzz-zzzzzzz 1zzzzzzz zzzzzzz"), (8, "x" * 100_000 + " "), (9, ("y" * 3000 + " ") * 5), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, "w") for d in docs], "doc_id long, text string, word string")
    got = rows(spelling.grouped(df, one_in=19))
    assert len(got) == len(set(got)) and set(got) == plain(docs, one_in=19)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_registered_query(spark):
    from riskline.llm import catalog

    docs = rows(catalog.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"))
    assert set(rows(catalog.op12_spelling_variants(spark, "/root/testdata/sf0.001"))) == plain(docs)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows(spelling.grouped(none)) == []


def test_depth_follows_the_number_of_words():
    assert [spelling._depth(n) for n in (0, 1, 400_000, 10**6, 10**12)] == [1, 1, 2, 3, 14]
    assert np.array_equal(spelling.vectors(["eel", "ÿ"])[:, [0, 8, 14]], [[2, 1, 0], [0, 0, 1]])
