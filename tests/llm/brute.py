"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def quality(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def line_dedup(docs, words=6, lines=2):
    """Lines that runs of that size cover which occur earlier; docs: (doc_id, text) with distinct ids."""
    worded = {d: [(p, x.strip(" \t\n\x0b\x0c\r"), len(WORD.findall(x))) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in docs}
    first, out = {}, {}
    for d in sorted(worded):
        a, gone = worded[d], set()
        for s in range(len(a)):
            for e in range(s, min(len(a), s + 2 * lines)):
                run = a[s : e + 1]
                if sum(x[2] for x in run) >= words or len(run) >= lines:
                    if first.setdefault(tuple(x[1] for x in run), (d, s)) < (d, s):
                        gone.update(x[0] for x in run)
        out[d] = gone
    return out


def fingerprint(t, k=4):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))


def components(fps, radius=4):
    """Smallest id reachable for each (id, fingerprint)."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    arr = np.array([f for _, f in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= radius):
            a, b = root(i), root(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def repeated_bytes(docs, window=100):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if b[s : s + window] in seen:
                gone[s : s + window] = True
            seen.add(b[s : s + window])
        starts = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out[d] = len(b), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    return out


def water(sizes, weights, budget, ceiling):
    """Targets of sources in order, by resharing the excess again and again."""
    total, capped = budget * sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(ceiling * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        more = {i for i in open_ if share[i] >= ceiling * sizes[i]}
        if not more:
            return [ceiling * s if i in capped else share[i] for i, s in enumerate(sizes)]
        capped |= more
