"""Pages, vectors, suffix sorting, the registered queries and the pipeline."""

import glob
import os
import random
import sys
import tempfile

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402

from riskline.llm import ann, catalog, html_extract, induced, suffix_dedup  # noqa: E402
from riskline.operators import lineage  # noqa: E402

SF = "/root/testdata/sf0.001"

PAGES = {
    "": "",
    "<body><main><h1>A</h1><script>var a='<p>no</p>'</script><p>x &amp;amp; y<ul><li>one<li>two</ul></main><div class='cookie-notice'>We use cookies here.</div>": "A\nx &amp; y\none\ntwo",
    "<nav><a href=1>Home</a></nav><article><p>First  part\n here.</p><div class=ad>Buy this now.</div><p>Be. <b>Yes</b></p><section id=comments><p>Nice words, I agree.</p></section></article>"
    "<aside>More to read</aside><form><label>Name</label></form><footer>&copy; us</footer>": "First part here.\nBe. Yes",
    "<div id=header>Site</div><div class=content><h2>T</h2><p>A paragraph with several words in it. And more.</p><p>Next one, also long enough.</p></div><!-- <p>no</p> -->": "T\nA paragraph with several words in it. And more.\nNext one, also long enough.",
}


@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.layouts())


def test_pages(model):
    for source, text in PAGES.items():
        assert html_extract.extract(source, model) == text


#: Pages labelled by hand, none of a kind that the training pages are put together in.
BARE = {
    "<html><body>The harbour was quiet that morning, and only two boats had gone out before the fog came in from the north. Nobody spoke much.</body></html>":
        "The harbour was quiet that morning, and only two boats had gone out before the fog came in from the north. Nobody spoke much.",
    "<body><center>Notes on a small museum of clocks, which opened in the spring and has been full of visitors ever since.</center></body>":
        "Notes on a small museum of clocks, which opened in the spring and has been full of visitors ever since.",
    "<table><tr><td>In the second year the committee decided to publish all of its letters, and they fill nine volumes on the shelf.</td></tr></table>":
        "In the second year the committee decided to publish all of its letters, and they fill nine volumes on the shelf.",
    "<html><body><pre>A plain text page\nof several lines that someone\nput on the web a long time ago, and nothing else besides.</pre></body></html>":
        "A plain text page of several lines that someone put on the web a long time ago, and nothing else besides.",
    "<html><head><title>x</title></head><body><h1>On rivers</h1>Rivers are older than the towns that stand on them, and they will be there when the towns have gone away.</body></html>":
        "On rivers\nRivers are older than the towns that stand on them, and they will be there when the towns have gone away.",
    "<body><div id='navbar'><a href='/'>Home</a> <a href='/a'>About</a></div><article><div class='post-header'><h1>The long way round</h1></div><p>We went by the coast, as the pass was closed.</p></article><footer>2020</footer></body>":
        "The long way round\nWe went by the coast, as the pass was closed.",
    "<body><nav><a href=1>One</a><a href=2>Two</a></nav>The paper was written in a week and read by nobody for eleven years, until a student found it.<footer>Imprint</footer></body>":
        "The paper was written in a week and read by nobody for eleven years, until a student found it.",
}


def test_text_without_paragraphs(model):
    for source, text in BARE.items():
        assert html_extract.extract(source, model) == text


def test_pages_of_the_table_by_their_markup(spark):
    """The whole table against the articles that its markup names, read by another parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.away, self.out = 0, [], []

        def handle_starttag(self, tag, attrs):
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            if tag == "article":
                self.depth += 1
            elif self.depth and (self.away or tag in ("nav", "aside", "form", "footer", "header", "script", "style") or named):
                self.away.append(tag)
            if self.depth and not self.away and tag in ("p", "h1", "h2", "h3", "li", "blockquote"):
                self.out.append("")

        def handle_endtag(self, tag):
            if self.away and tag == self.away[-1]:
                self.away.pop()
            elif tag == "article":
                self.depth -= 1

        def handle_data(self, data):
            if self.depth and not self.away and self.out:
                self.out[-1] += data

    rows = {r["page_id"]: r["html"] for r in catalog.table(spark, SF, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in catalog.op1_html_extraction(spark, SF).collect()}
    assert got.keys() == rows.keys()
    same = seen = 0
    for k, source in rows.items():
        if source and source.count("<article") == 1:
            reader = Reader()
            reader.feed(source)
            seen += 1
            same += got[k] == "\n".join(t for x in reader.out if (t := " ".join(x.split())))
    assert seen > 20 and same == seen


def test_long_attributes(model):
    """Quoted values of any length and number belong to their tag, and what they hold is no markup."""
    value = "x" * 2500 + "<b>bold</b> more <div class='content'>"
    many = " ".join(f'data-a{i}="{i} > 0"' for i in range(120))
    for attributes in (f'data-x="{value}"', many, f'srcdoc="{value}" {many}'):
        page = html_extract.parse(f'<body><div {attributes} class="sidebar">text</div><p>after</p></body>')
        assert [t for _, t in page.blocks] == ["text", "after"]
        side = html_extract.INDEX["hint side"]
        assert side in page.features[page.blocks[0][0]] and html_extract.INDEX["hint content"] not in page.features[page.blocks[0][0]]
    # A quote that never closes ends with the tag; one that begins no value is none; neither takes more than linear time.
    assert [t for _, t in html_extract.parse('<p class="a>one</p><p don\'t>two</p>').blocks] == ["one", "two"]
    page = html_extract.parse('<p a=">" ' * 100_000 + '<p b="')
    assert len(page.names) == 100_001
    assert [t for _, t in html_extract.parse("<p>a</p> b <" + "i<i" * 100_000).blocks][0] == "a"


def test_held_out_layouts(model):
    right = total = 0
    for page, labels in html_extract.layouts(40, seed=99):
        total += len(labels)
        right += sum((p > 0.5) == bool(y) for p, y in zip(model.marginals(page), labels, strict=True))
    assert right / total > 0.97


def test_marginals_are_exact(model):
    """Sum-product against all states of a small page."""
    page = html_extract.parse("<body><nav><ul><li>a</li></ul></nav><article><h1>b</h1><p>c d e.</p></article></body>")
    n, scores = len(page.parent), []
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        score = sum(model.node[f] for i in range(n) if y[i] for f in page.features[i])
        scores.append((y, score + sum(model.edge[page.edge[i]][y[page.parent[i]]][y[i]] for i in range(1, n))))
    weight = np.exp([s for _, s in scores])
    exact = (weight[:, None] * np.array([y for y, _ in scores])).sum(0) / weight.sum()
    assert np.allclose(model.marginals(page), exact, atol=1e-9)


def test_pages_table(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "<p" * 5000, "t"), (3, "u", "<div>" * 5000 + "x", "t"), (None, "u", list(PAGES)[2], "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extracted(df).collect()
    assert len(got) == 5 and [r["text"] for r in got if r["page_id"] in (1, None)] == ["", "", PAGES[list(PAGES)[2]]]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extracted(df.where("page_id > 9")).collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((600, 16)).astype(np.float32)
    vectors[100:300] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (800, [float("inf")] * 16), (900, [1.0]), (None, [1.0] * 16), (703, [None] * 16), (5, vectors[5].tolist())]
    got = ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(by) == [0, 100, 200, 300, 400, 500]
    hits = 0
    for q, found in by.items():
        far = np.sqrt(((vectors.astype(np.float64) - vectors[q].astype(np.float64)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(600), far)) if i != q][:10]
        assert len(found) == 10 and all(abs(far[v] - s) < 1e-12 for v, s in found)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
        hits += len(set(want) & {v for v, _ in found})
        if q in (100, 200):
            assert [v for v, _ in found] == want
    assert hits >= 0.9 * 60
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 2), (2, 1)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("held", [2_000_000, 7])
def test_suffix_order(held, monkeypatch):
    monkeypatch.setattr(induced, "HELD", held)
    monkeypatch.setattr(induced, "BLOCK", 1 << 15 if held > 7 else 3)
    rng = random.Random(1)
    with tempfile.TemporaryDirectory() as path:
        for k in range(400):
            t = bytes(rng.randint(0, rng.choice([1, 3, 255])) for _ in range(rng.randint(0, 40))) * (1 if k % 4 else rng.randint(1, 6))
            order, want = sorted(range(len(t)), key=lambda i: t[i:]), []
            for j, i in enumerate(order):
                shared = 0 if j == 0 else len(os.path.commonprefix([t[i:], t[order[j - 1] :]]))
                want.append((i, min(shared, 20)))
            blocks = induced.suffixes(np.frombuffer(t, np.uint8), 20, induced.Folder(path))
            assert [(int(i), int(n)) for at, lengths in blocks for i, n in zip(at, lengths, strict=True)] == want


def test_small_levels_are_sorted_in_memory(monkeypatch):
    """Names that fit in memory do not go through the queue tuple by tuple; order and lengths are those of the queue."""

    def slow(*args):
        raise AssertionError("a small level went tuple by tuple")

    rng = random.Random(2)
    words = [bytes(rng.randint(97, 110) for _ in range(rng.randint(2, 9))) for _ in range(40)]
    text = b" ".join(rng.choice(words) for _ in range(2_000)) + b"ab" * 300 + b" ".join(words * 3)
    text = np.frombuffer(text, np.uint8)

    def found():
        with tempfile.TemporaryDirectory() as path:
            return [(int(i), int(n)) for at, lengths in induced.suffixes(text, 100, induced.Folder(path)) for i, n in zip(at, lengths, strict=True)]

    with monkeypatch.context() as m:
        m.setattr(induced, "HELD", 7)
        by_queue = found()
    monkeypatch.setattr(induced, "_feed_names", slow)
    assert found() == by_queue


def test_runs_are_not_kept_beside_their_shuffle(spark):
    """All runs take more room than the texts: only those that are left after the shuffle are written."""
    before = set(lineage._MADE.get(spark.sparkContext.applicationId, []))
    docs = spark.createDataFrame([(i, f"{i} " * 60 + "passage of words " * 12) for i in range(6)], "doc_id long, text string")
    assert suffix_dedup.repeated_spans(docs).count()
    made = set(lineage._MADE[spark.sparkContext.applicationId]) - before
    assert sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made) == ["runs", "spans"]


def test_recall_on_the_table(spark):
    rows = catalog.op3_ann(spark, "/root/testdata/sf0.01").collect()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x, ids = np.array(table["embedding"].tolist(), np.float64), table["vec_id"].to_numpy()
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, far))] if i != q][:10]
        hits += len(set(want) & {r["vec_id"] for r in rows if r["query_id"] == q})
    assert hits >= 0.9 * len(rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_tables_against_plain_versions(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    fps = [(d, brute.fingerprint(t)) for d, t in docs]
    got = {r["doc_id"]: r for r in catalog.op7_simhash(spark, SF).collect()}
    assert [(got[d]["fingerprint"], got[d]["component_id"]) for d, _ in docs] == [(f"{f:016x}", c) for (_, f), c in zip(fps, brute.components(fps), strict=True)]
    got = {r["doc_id"]: tuple(r)[1:] for r in catalog.op5_suffix_dedup(spark, SF).collect()}
    assert got == brute.repeated_bytes(docs)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in catalog.op4_bpe(spark, SF).collect()}
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in docs}
    assert catalog.op1_html_extraction(spark, SF).where("n_chars > 0").count() > 0
    assert catalog.op6_token_counts(spark, SF).where("n_edits > 0 AND n_encoded > 0").count() > 0
    assert catalog.op2_source_mixing(spark, SF).count() == catalog.op9_license_scan(spark, SF).count() == len(docs)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.dtypes, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        tables.append(docs.collect())
        if len(tables) < len(corpus_pipeline.STAGES):
            assert docs.dtypes == columns
    clean, cut, one, mixed, tokens = tables
    kept = {r["doc_id"] for r in catalog.op8_quality_rules(spark, SF).where("kept").collect()}
    assert {r["doc_id"] for r in clean} == kept
    gone = brute.line_dedup([(r["doc_id"], r["text"]) for r in clean])
    want = {}
    for r in clean:
        lines = [(p, x) for p, x in enumerate(r["text"].split("\n"))]
        worded = [p for p, x in lines if brute.WORD.search(x)]
        if not worded or set(worded) - gone[r["doc_id"]]:
            want[r["doc_id"]] = "\n".join(x for p, x in lines if p not in gone[r["doc_id"]])
    assert {r["doc_id"]: r["text"] for r in cut} == want
    rows = sorted((r["doc_id"], brute.fingerprint(r["text"])) for r in cut)
    assert sorted(r["doc_id"] for r in one) == sorted(set(brute.components(rows)))
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in one} and all(r["n_chars"] == len(r["text"]) for r in mixed)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(tokens) == len(mixed)
    assert all(np.frombuffer(r["token_ids"], "<u4").tolist() == library.encode(r["text"], add_special_tokens=False).ids for r in tokens)
