"""License scans by matching statistics against a suffix automaton of notices.

The words of every notice, whole licence text and phrase are one generalised suffix
automaton.  A text is streamed through it word by word; at each word it gives the
longest run of words ending there that some notice holds (the matching statistics),
and its suffix links give the suffix of that run which each other notice holds.  Runs
that a notice cannot make longer and that have at least ``MIN_RUN`` words are chained for
it: runs in order in the text and in the notice, with at most ``MAX_GAP``
foreign words between them, cover the words of a span.  A name of a licence is never
bridged: foreign or missing words in it name another licence, and so do words behind a name that
make a longer one of it.  A notice whose covered
share reaches ``COVERED`` gives its label.  The phrases of the base rule are whole
strings of the same automaton, so each of their places ends at a state that
holds them.

NULL text counts as empty: no words, no labels, score 0.  Texts of any length take
one pass; repeated rows are scanned each; an empty table stays empty; added columns
replace columns of the same name, all others pass unchanged.
"""

from __future__ import annotations

import pkgutil
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskline.llm.bpe import Automaton
from riskline.llm.rowwise import with_columns_of

# The phrases of the base rule with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Openings of public notices with the labels that the chains give.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("mit", "spdx license identifier mit"),
    ("isc", "spdx license identifier isc"),
    ("apache", "spdx license identifier apache 2 0"),
    ("bsd", "spdx license identifier bsd 2 clause"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("gpl", "spdx license identifier gpl 2 0"),
    ("gpl", "spdx license identifier gpl 3 0"),
    ("lgpl", "spdx license identifier lgpl 2 1"),
    ("lgpl", "spdx license identifier lgpl 3 0"),
    ("agpl", "spdx license identifier agpl 3 0"),
    ("mpl", "spdx license identifier mpl 2 0"),
    ("epl", "spdx license identifier epl 2 0"),
    ("unlicense", "spdx license identifier unlicense"),
    ("cc0", "spdx license identifier cc0 1 0"),
    ("cc-by", "spdx license identifier cc by 4 0"),
    ("cc-by-sa", "spdx license identifier cc by sa 4 0"),
]
# What may follow the attribution licence's name, with the labels.
ATTRIBUTION = [
    ("cc-by-nc", "noncommercial"), ("cc-by-sa", "sharealike"), ("cc-by-nd", "noderivatives"), ("cc-by-nd", "noderivs"),
    ("cc-by-nc-sa", "noncommercial sharealike"), ("cc-by-nc-nd", "noncommercial noderivatives"), ("cc-by-nc-nd", "noncommercial noderivs"),
    ("cc-by-nc", "non commercial"), ("cc-by-sa", "share alike"), ("cc-by-nd", "no derivatives"),
    ("cc-by-nc-sa", "non commercial share alike"), ("cc-by-nc-nd", "non commercial no derivatives"),
]
NOTICES += [(label, f"licensed under a creative commons attribution {more} 4 0 international license") for label, more in ATTRIBUTION]
# Names of licences, which a chain covers without a gap or not at all.
NAMES = [
    "gnu general public license", "gnu lesser general public license", "gnu library general public license", "gnu affero general public license",
    "gnu free documentation license", "apache license", "mozilla public license", "eclipse public license", "mit license", "artistic license",
    "creative commons attribution", "cc by", "cc by sa", "cc by nc", "cc by nd", "cc by nc sa", "cc by nc nd",
    *[f"creative commons attribution {more}" for _, more in ATTRIBUTION],
]
#: Whole texts of licences, by file in ``licenses``.
TEXTS = {
    "Apache-2.0": "apache", "Artistic": "artistic", "BSD": "bsd", "CC0-1.0": "cc0", "GFDL-1.2": "gfdl", "GFDL-1.3": "gfdl", "GPL-1": "gpl", "GPL-2": "gpl",
    "GPL-3": "gpl", "LGPL-2": "lgpl", "LGPL-2.1": "lgpl", "LGPL-3": "lgpl", "MPL-1.1": "mpl", "MPL-2.0": "mpl",
}
NOTICES += [(label, pkgutil.get_data(__package__, f"licenses/{name}.txt").decode()) for name, label in TEXTS.items()]
MIN_RUN, MAX_GAP, COVERED = 3, 4, 0.8

#: Lower-cases A-Z and makes every separating byte a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Scanner:
    """Scans texts against the phrases and notices."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES):
        texts = [*phrases, *[n for _, n in notices]]
        self.labels = [*phrases.values(), *[label for label, _ in notices]]
        self.n_phrases = len(phrases)
        split = [tuple(words_of(t)) for t in texts]
        self.lengths = [len(s) for s in split]
        self.known = {w for s in split for w in s}
        # A notice equal to a phrase adds nothing to it.
        self.automaton = Automaton({s: k for k, s in reversed(list(enumerate(split)))})
        self.split = split
        self.places = self._places(split)
        names = [tuple(words_of(n)) for n in NAMES]
        self.behind = self._behind(names)
        self.names: dict[bytes, list[tuple[bytes, ...]]] = defaultdict(list)
        for n in sorted(names, key=len, reverse=True):
            self.names[n[0]].append(n)

    def _places(self, split: list[tuple[bytes, ...]]) -> list[list[tuple[int, int]]]:
        """For each state the (notice, end) at which its words stand."""
        sam = self.automaton
        found: list[list[tuple[int, int]]] = [[] for _ in sam.next]
        for k, s in enumerate(split):
            state = 0
            for i, w in enumerate(s, 1):
                state = sam.next[state][w]
                u = state
                while u and sam.size[u] >= MIN_RUN:
                    found[u].append((k, i))
                    u = sam.link[u]
        return found

    def _behind(self, names: list[tuple[bytes, ...]]) -> list[list[int]]:
        """For each notice and place in it the end of the last name that begins before the place, which a gap there must not touch."""
        known = {n: len(n) for n in names}
        sizes = sorted({len(n) for n in names}, reverse=True)
        out = []
        for s in self.split:
            ends, end = [0], 0
            for i in range(len(s)):
                end = max(end, i + next((n for n in sizes if s[i : i + n] in known), 0)) if i >= end else end
                ends.append(end if end > i else ends[-1])
            out.append(ends)
        return out

    def statistics(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(end, state, length) of the longest known run ending at each word that is part of one."""
        sam, known = self.automaton, self.known
        arcs, link, size = sam.next, sam.link, sam.size
        out = []
        state = length = 0
        before = -1
        for i, w in enumerate(words):
            if w not in known:
                continue
            if i != before + 1:
                state = length = 0
            before = i
            while state and w not in arcs[state]:
                state = link[state]
                length = size[state]
            if w in arcs[state]:
                state = arcs[state][w]
                length += 1
                out.append((i + 1, state, length))
        return out

    def scan(self, text: str) -> tuple:
        """n_words, places of phrases as (phrase, start), covered spans as (notice, start, end, share)."""
        words = words_of(text)
        stats = self.statistics(words)
        sam = self.automaton
        base = [
            (k, end - n)
            for end, state, length in stats
            for k, n in sam.ends[state if sam.size[state] <= length else sam.link[state]]
            if k < self.n_phrases
        ]
        return len(words), base, self._chains(self._pieces(words, stats), self._inside(words))

    def _inside(self, words: list[bytes]) -> set[int]:
        """The places inside a name, the longest that begins at its first word."""
        out: set[int] = set()
        for i, w in enumerate(words):
            if w in self.names:
                size = next((len(n) for n in self.names[w] if tuple(words[i : i + len(n)]) == n), 0)
                out.update(range(i + 1, i + size))
        return out

    def _pieces(self, words: list[bytes], stats: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """For each notice the runs that it holds and cannot make longer, as (start, place, length)."""
        sam, split = self.automaton, self.split
        by_notice: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, state, length in stats:
            after = words[end] if end < len(words) else None
            seen: set[tuple[int, int]] = set()
            while state and length >= MIN_RUN:
                for k, at in self.places[state]:
                    # An occurrence can be shorter than the state's longest words, never than the run.
                    if at >= length and (k, at) not in seen:
                        seen.add((k, at))
                        if at == len(split[k]) or split[k][at] != after:
                            by_notice[k].append((end - length, at - length, length))
                state = sam.link[state]
                length = min(length, sam.size[state])
        return by_notice

    def _chains(self, by_notice: dict[int, list[tuple[int, int, int]]], inside: set[int]) -> list[tuple[int, int, int, float]]:
        """The best chain of each notice around each place, as (notice, start, end, covered share)."""
        spans = []
        for k, pieces in by_notice.items():
            pieces.sort()
            behind = self.behind[k]
            best: list[tuple[int, int]] = []  # words covered and first word, of the best chain that ends with each piece
            ending: dict[int, list[int]] = defaultdict(list)
            for j, (start, at, length) in enumerate(pieces):
                covered, first = length, start
                for stop in range(start - MAX_GAP, start + 1):
                    if stop < start and stop in inside:
                        continue
                    for i in ending.get(stop, ()):
                        if behind[at] <= pieces[i][1] + pieces[i][2] <= at and best[i][0] + length > covered:
                            covered, first = best[i][0] + length, best[i][1]
                best.append((covered, first))
                ending[start + length].append(j)
            spans += [(k, first, start + length, covered / self.lengths[k]) for (start, _, length), (covered, first) in zip(pieces, best, strict=True)]
        return spans


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType()),
    ]))),
]


def describe(scanner: Scanner, text: str) -> tuple:
    """The values of FIELDS for a text."""
    n_words, base, chains = scanner.scan(text)
    starts = [s for _, s in base]
    base_labels = sorted({scanner.labels[k] for k, _ in base})
    full = [(k, a, b, share) for k, a, b, share in chains if share >= COVERED and k >= scanner.n_phrases]
    labels = sorted({*base_labels, *[scanner.labels[k] for k, *_ in full]})
    score = 1.0 if base else max([share for *_, share in chains], default=0.0)
    spans = [{"label": scanner.labels[k], "first": a, "end": b, "share": share} for k, a, b, share in sorted(full, key=lambda c: (c[1], c[2], c[0]))]
    return n_words, len(base), min(starts, default=None), max(starts, default=None), base_labels, labels, score, spans


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, text: str = "text") -> DataFrame:
    """``docs`` with FIELDS: counts and places of phrases, labels, score and covered spans."""

    def start():
        scanner = Scanner(phrases, notices)
        return lambda t: describe(scanner, t)

    return with_columns_of(docs, text, FIELDS, start)
