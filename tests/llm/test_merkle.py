"""Manifests against plain trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskline.llm import catalog, merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(leaves):
    """Root and, for each leaf, the siblings by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 8 : i - i % 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes, at = [h("".join(nodes[j : j + 8])) for j in range(0, len(nodes), 8)], [i // 8 for i in at]
    return (nodes[0] if nodes else None), paths


def manifest(rows):
    """(order, leaf) by group -> (order, leaf, subroot, root, witness) of every row."""
    groups = {}
    for g, o, d in rows:
        groups.setdefault(g, []).append((o, d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in order}
    trees = {g: plain([d for _, d in made[g]]) for g in order}
    root, upper = plain([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, upper, strict=True):
        for (o, d), low in zip(made[g], trees[g][1], strict=True):
            out.append((g, o, d, trees[g][0], root, tuple(low + up)))
    return out


def key(row):
    return tuple((v is not None, v) if not isinstance(v, tuple) else v for v in row)


def test_appender_is_the_plain_tree():
    for n in [*range(1, 20), 63, 64, 65, 513]:
        leaves = [h(str(i)) for i in range(n)]
        tree = merkle.Appender(merkle.height(n))
        for d in leaves:
            tree.append(d)
        root, paths = plain(leaves)
        assert tree.finish() == root and tree.witnesses == paths


def test_partial_witnesses():
    """A leaf's witness ends where the first open run above it stands."""
    tree = merkle.Appender(2)
    for i in range(9):
        tree.append(h(str(i)))
    assert [len(w) for w in tree.witnesses] == [1] * 8 + [0]


@pytest.mark.parametrize("levels", [merkle.LEVELS, 1])
def test_manifest(spark, levels):
    """Groups of many sizes, NULL groups and orders, repeated rows; with blocks of one level there are many rounds."""
    rng = random.Random(5)
    sizes = {None: 9, "": 1, "a": 64, "b": 65, "é": 8, "z": 2, "hot": 700, **{f"g{i}": 1 for i in range(4)}}
    rows = [(g, rng.choice([None, *range(n)]), h(str(rng.randrange(n)))) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame([(g, o, d, "x") for g, o, d in rows], "lang string, doc_id long, leaf string, Root string").repartition(5)
    got = merkle.manifest(df, "lang", "doc_id", "leaf", levels)
    assert got.columns == ["lang", "doc_id", "leaf", "subroot", "root", "witness"]
    found = [(*r[:5], tuple((s["left"], s["right"]) for s in r[5])) for r in got.collect()]
    assert sorted(found, key=key) == sorted(manifest(rows), key=key)
    bad = got.where(merkle.folded(F.col("leaf"), F.col("witness")) != F.col("root")).count()
    assert bad == 0
    assert got.where(merkle.folded(F.sha2("leaf", 256), F.col("witness")) == F.col("root")).count() == 0
    assert merkle.manifest(df.where("doc_id > 10000"), "lang", "doc_id", "leaf").collect() == []
    one = merkle.manifest(df.where("lang = ''"), "lang", "doc_id", "leaf").first()
    assert one["root"] == one["subroot"] == one["leaf"] and one["witness"] == []


def test_registered_query(spark):
    """Tampered documents against a plain computation over the whole table."""
    docs = [tuple(r) for r in catalog.table(spark, "/root/testdata/sf0.001", "documents").select(*catalog.MANIFEST).collect()]
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: h("".join(map(field, row)))
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = {r[0]: r for r in docs}
    want = {}
    for _, d, digest, subroot, root, path in manifest([(r[2], r[0], leaf(r)) for r in docs]):
        row = rows[d]
        acc = digest
        if zlib.crc32(str(d).encode()) % 3 == 0:
            acc = leaf((*row[:-1], row[-1].translate(small) if row[-1] is not None else None))
        for left, right in path:
            acc = h(left + acc + right)
        want[d] = (d, digest, subroot, root, h("".join(a + b for a, b in path)), acc, acc == root)
    got = {r["doc_id"]: tuple(r) for r in catalog.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and {v[-1] for v in got.values()} == {True, False}
