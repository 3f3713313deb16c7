"""The text operators against plain versions, on made texts and on odd rows."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from riskline.llm import bpe, edit_tokens, license_scan, line_dedup, quality_rules, simhash, source_mixing, suffix_dedup  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, copies string, body string, n_words string, size string"
PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def made_texts(n, seed):
    """Texts of words and lines that repeat within and across them."""
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "éa", "x,", "and.", "MIT", "license", "one.", "two!", "###", "a|b"]
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, 45]))) + "." for _ in range(12)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
        elif kind < 0.4 and out:
            w = rng.choice(out).split(" ")
            w[rng.randrange(len(w))] = "edit"
            out.append(" ".join(w))
        else:
            out.append("\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randint(0, 9))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "f", "c", "b", "w", "z") for d, t, s in rows], COLUMNS)


@pytest.fixture(scope="module")
def texts():
    return made_texts(60, 3)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]).cache()


@pytest.fixture(scope="module")
def odd(spark):
    long = "word and more. " * 20_000
    passage = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [(0, None, "a"), (1, "", None), (2, " \n\t\n", ""), (3, long, "a"), (3, long, "a"), (None, passage, None), (None, None, None),
            (5, passage, "b"), (5, passage, "b"), (6, "short", "a"), (7, passage, "a"), (7, "other text here", "a")]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [(1, "x", "a")]).where("doc_id > 5")


def test_quality_counts(docs, texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t)
        assert not (r["base_failed"] and r["kept"])


def test_quality_lines(spark):
    prose = "This is a sentence with a good number of words in it, as it should be. " * 2
    bad = ["Home | About | News | Contact | Login", "Please accept all cookies on this page.", "### *** %%% $$$ ### ***.", "Menu", "WOW! BUY! NOW! YES! GO!"]
    text = "\n".join([prose.strip(), *bad, "", prose.strip()[5:]])
    r = quality_rules.judge(frame(spark, [(1, text, "s")])).first()
    assert r["n_lines_removed"] == len(bad) and r["clean_text"] == "\n".join([prose.strip(), "", prose.strip()[5:]])
    lost = quality_rules.judge(frame(spark, [(1, "\n".join([prose.strip(), *bad * 9]), "s")])).first()
    assert not lost["kept"]


def test_line_runs(docs, texts):
    want = brute.line_dedup(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in line_dedup.dedup(docs).collect()}
    assert any(want.values())
    for i, t in enumerate(texts):
        kept = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i])
        assert (got[i]["n_lines_removed"], got[i]["clean_text"]) == (len(want[i]), kept)


def test_fingerprints_and_components(docs, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [(i, brute.fingerprint(t)) for i, t in enumerate(texts)]
    assert [got[i]["fp"] & ((1 << 64) - 1) for i, _ in fps] == [f for _, f in fps]
    assert [got[i]["component_id"] for i, _ in fps] == brute.components(fps)


def test_fingerprints_in_parts(spark, monkeypatch):
    """Many near fingerprints under one key, made in slices, against all pairs."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    monkeypatch.setattr(simhash, "SLICE", 5_000)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    # Executors import the module anew, so the slices are tested here and the whole in Spark.
    found = simhash._collide(np.array(fps, np.uint64), 0, 0, 2, 4)
    labels = brute.components(list(enumerate(fps)))
    groups = {}
    for f, g in zip(fps, labels, strict=True):
        groups[f] = g
    assert all(groups[int(a) & ((1 << 64) - 1)] == groups[int(b) & ((1 << 64) - 1)] for a, b in found)
    assert len(found) == len(fps) - len(set(labels))
    classes = {r["fp"] & ((1 << 64) - 1): r["label"] for r in simhash.classes(spark.createDataFrame(signed, "fp long"), 4).collect()}
    for a, b in zip(fps, fps[1:], strict=False):
        assert (classes[a] == classes[b]) == (groups[a] == groups[b])


def test_mix(docs, texts):
    rows = source_mixing.mix(docs).collect()
    sizes = [len(brute.WORD.findall(t)) for t in texts]
    per = [sum(s for i, s in enumerate(sizes) if i % 3 == k) for k in range(3)]
    want = brute.water(per, [3, 1, 2], 1.5, 2.0)
    taken = [0, 0, 0]
    for r in rows:
        k = r["doc_id"] % 3
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == per[k] and abs(r["target"] - want[k]) < 1e-6
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[k] += r["taken"]
    assert all(abs(t - w) <= max(sizes) for t, w in zip(taken, want, strict=True))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, source_mixing.mix(docs.repartition(5)).collect()))


def test_mix_tree(spark, monkeypatch):
    """A hot source over several leaves and levels keeps its total to within one document."""
    monkeypatch.setattr(source_mixing, "LEAF", 20)
    monkeypatch.setattr(source_mixing, "FAN", 3)
    sized = spark.range(900).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'x', 'y')").alias("source"), (F.col("id") % 17 + 1).alias("size"))
    out = source_mixing.copies(sized).groupBy("target").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in out) == 900 and all(abs(r["t"] - r["target"]) <= 17 for r in out)


def test_bpe(docs, texts):
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH).collect()}
    for i, t in enumerate(texts):
        e = library.encode(t, add_special_tokens=False)
        assert np.frombuffer(got[i]["token_ids"], "<u4").tolist() == e.ids
        assert got[i]["decoded"] == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_odd_characters():
    with open(PATH, encoding="utf-8") as f:
        mine = bpe.Encoder(f.read())
    library, rng = Tokenizer.from_file(PATH), random.Random(1)
    parts = [*"abcdeéÉèßİΣςσ'stre.,!?-_0123 \t\n\x1c\x1f\x85\xa0汉カ한😀‍­\x00", "<|endoftext|>", "<|startoftext|>", "</w>", "'ll", "the", "ing", "tion", "ﬁ", "Å"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        e = library.encode(s, add_special_tokens=False)
        ids, decoded = mine.encode(s)
        assert (np.frombuffer(ids, "<u4").tolist(), decoded) == (e.ids, library.decode(e.ids, skip_special_tokens=False)), s


def test_licenses(docs, texts, spark):
    for r in license_scan.scan(docs).collect():
        words = [w.decode() for w in license_scan.words_of(texts[r["doc_id"]])]
        places = [(i, v) for p, v in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"] == len(words) or r["n_words"] is not None) and r["n_base"] == len(places)
        assert r["first_word"] == min([i for i, _ in places], default=None) and r["last_word"] == max([i for i, _ in places], default=None)
        assert r["base_labels"] == sorted({v for _, v in places}) and set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    text = "Permission is hereby granted, free of charge, to any person obtaining a NEW copy of this software and associated documentation files."
    r = license_scan.scan(frame(spark, [(1, text, "s"), ])).first()
    assert r["labels"] == ["mit"] and r["base_labels"] == [] and r["spans"][0]["first"] == 0 and r["spans"][0]["share"] == 1.0


def test_whole_licenses_and_names():
    """Bodies give their label, longer matches of one notice hide nothing of another, and names are not bridged."""
    scanner = license_scan.Scanner()

    def labels(text):
        return license_scan.describe(scanner, text)[5]

    for name, label in license_scan.TEXTS.items():
        text = dict(zip(license_scan.TEXTS, license_scan.NOTICES[-len(license_scan.TEXTS) :], strict=True))[name][1]
        assert label in labels(text)
        middle = license_scan.words_of(text)
        assert label in labels(b" ".join([*middle[:100], b"zzz", *middle[100:]]).decode())
    agpl = "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"
    assert labels(agpl) == ["agpl"]
    assert labels(agpl.replace("Affero ", "")) == ["gpl"] and labels(agpl.replace("Affero", "Lesser")) == ["lgpl"]
    assert labels("Licensed under CC BY-NC-SA 4.0") == ["cc-by", "cc-by-nc-sa"] and labels("Licensed under CC BY-SA 4.0") == ["cc-by", "cc-by-sa"]
    # The first notice holds the longer run at every word; the second still gets the part that it holds.
    two = license_scan.Scanner({}, [("a", "p q r s t u v"), ("b", "x r s t y")])
    assert sorted(two.scan("p q r s t u v")[2]) == [(0, 0, 7, 1.0), (1, 2, 5, 0.6)]


def test_repeated_bytes(docs, texts, spark):
    got = {r["doc_id"]: r for r in suffix_dedup.removed(docs, shard=500).withColumn("h", F.sha2("kept", 256)).collect()}
    want = brute.repeated_bytes(list(enumerate(texts)))
    assert any(w[1] for w in want.values())
    for i in want:
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["h"]) == want[i]
    periodic = [(1, "ab" * 120), (2, "a" * 400), (3, "é" * 60 + "ab" * 60), (4, "ab" * 49), (5, "x" + "a" * 150 + "y")]
    got = {r["doc_id"]: r for r in suffix_dedup.removed(frame(spark, [(*p, "s") for p in periodic])).withColumn("h", F.sha2("kept", 256)).collect()}
    for i, w in brute.repeated_bytes(periodic).items():
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["h"]) == w


def test_runs_are_found_once(spark, monkeypatch):
    """What a batch leaves out as copies depends on its rows, so the rows may be searched only once."""
    passes = spark.sparkContext.accumulator(0)
    passage = " ".join(f"w{i}" for i in range(60))
    found = suffix_dedup._runs

    def counted(keyed, window, gram):
        def count(batches):
            for b in batches:
                passes.add(b.num_rows)
                yield b

        return found(keyed.mapInArrow(count, keyed.schema), window, gram)

    monkeypatch.setattr(suffix_dedup, "_runs", counted)
    rows = [(i, passage, "s") for i in range(40)]
    got = suffix_dedup.removed(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(i, len(passage) if i else 0) for i in range(40)]
    assert passes.value == len(rows)


def test_counts_after_edits(docs, texts, spark):
    state = edit_tokens.with_trees(docs, RANKS, public_tokenizers.PATTERN)
    rng, edits, want = random.Random(9), [], {}
    for i, t in enumerate(texts):
        own = sorted({rng.randint(0, len(t)) for _ in range(rng.randint(0, 4))})
        own = [(a, min(len(t), a + rng.choice([0, 1, 3])), rng.choice(["", "new", " 's", "\n\n"])) for a in own]
        edits += [(i, *e) for e in own]
        want[i] = edit_tokens.edited(t, edit_tokens.usable([{"start": a, "stop": b, "text": x} for a, b, x in own], len(t)))
    table = spark.createDataFrame([*edits, (0, 10**9, 10**9 + 1, "beyond"), (0, None, 1, "x")], "doc_id long, start long, stop long, text string")
    counter = edit_tokens.Counter(open(RANKS, encoding="utf-8").read(), public_tokenizers.PATTERN)
    for r in edit_tokens.apply_edits(edit_tokens.attach(state, table), RANKS, public_tokenizers.PATTERN).collect():
        assert r["text"] == want[r["doc_id"]]
        assert r["n_tokens"] == len(counter.encoding.encode_ordinary(r["text"])) and r["n_before"] == len(counter.encoding.encode_ordinary(texts[r["doc_id"]]))


OPERATORS = {
    "quality": quality_rules.judge, "keep_clean": quality_rules.keep_clean, "lines": line_dedup.dedup, "keep_first": line_dedup.keep_first,
    "simhash": simhash.near_duplicates, "one_of_each": simhash.one_of_each, "mix": source_mixing.mix, "mixed": source_mixing.mixed,
    "bpe": lambda d: bpe.encode(d, PATH), "licenses": license_scan.scan, "bytes": suffix_dedup.removed,
    "counts": lambda d: edit_tokens.apply_edits(edit_tokens.with_masks(edit_tokens.with_trees(d, RANKS, public_tokenizers.PATTERN)), RANKS, public_tokenizers.PATTERN),
}
#: Rows of the odd table that each operator returns.
ROWS = {"keep_clean": 4, "keep_first": None, "one_of_each": 5, "mixed": None}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, none, name):
    out = OPERATORS[name](odd)
    rows = out.collect()
    want = ROWS.get(name, 12)
    assert want is None or len(rows) == want
    assert len(set(map(str.lower, out.columns))) == len(out.columns)
    if name in ("keep_clean", "keep_first", "one_of_each", "mixed"):
        assert out.dtypes == odd.dtypes and {r["body"] for r in rows} == {"b"} and {r["n_words"] for r in rows} == {"w"}
    assert OPERATORS[name](none).collect() == []


def test_odd_values(odd):
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines_removed"]) for r in line_dedup.dedup(odd).collect())
    # The passage stays in document 5, both rows of it, and goes from 7 and from the one without an id.
    assert [x[2] for x in kept if x[1] in (5, 7)] == [0, 0, 0, 1] and sorted(x[2] for x in kept if x[0]) == [0, 1]
    ids = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert ids[(None, 0)] == 0 and ids[(1, 0)] == 0 and ids[(2, 0)] == 0
    gone = [(r["doc_id"], r["n_removed"] > 0) for r in suffix_dedup.removed(odd).collect() if r["n_bytes"] > 200 and r["n_bytes"] < 1000]
    assert sorted(gone, key=str) == [(5, False), (5, False), (7, True), (None, True)]


def test_long_names_of_licences():
    """What follows the attribution licence's name makes another licence of it."""
    scanner = license_scan.Scanner()
    label = lambda t: license_scan.describe(scanner, t)[5]
    name = "licensed under a Creative Commons Attribution{} 4.0 International License"
    for head in ("", "This work is "):
        assert label(head + name.format("-NonCommercial")) == ["cc-by-nc"]
        assert label(head + name.format("-NonCommercial-NoDerivatives")) == ["cc-by-nc-nd"]
        assert label(head + name.format("-NonCommercial-ShareAlike")) == ["cc-by-nc-sa"]
        assert label(head + name.format("-ShareAlike")) == ["cc-by-sa"]
        assert label(head + name.format("-NoDerivatives")) == ["cc-by-nd"]
    assert label("This work is " + name.format("")) == ["cc-by"]
    assert label("SPDX-License-Identifier: MIT") == ["mit"] and label("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl"]


def test_bpe_takes_letters_and_whole_tokens_without_search():
    """Runs of letters pass no split pattern, tokens no automaton; the ids stay those of the library."""
    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(open(PATH, encoding="utf-8").read())
    texts = ["The café ªº ŉame ǰ Ÿ STRASSE straße", "it's don't we'll 'tis x1y2 a\x1cb \x7f \x00z ² ʰ Aİ é"]
    for text in texts:
        ids, decoded = encoder.encode(text)
        own = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == own and decoded == library.decode(own, skip_special_tokens=False)
    encoder.split = encoder.automaton = None
    assert encoder._simple("Word") == ["word"] and len(encoder.tokens("the")) == 1
