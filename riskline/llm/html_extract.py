"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with two states, content or not.  A node has a
potential from its tag, its class, id and role, and its own text; each parent and child
share a potential on their pair of states.  On a tree sum-product message passing
is exact: messages go up once and down once and give each node its marginal.
The weights maximise the conditional likelihood of labelled pages, whose gradient
comes from the same marginals.  Blocks of nodes with a marginal over one half are
the text.

Pages are labelled in two ways: LAYOUTS builds pages from labelled parts, and up to
SAMPLE pages of the table whose markup names one article are labelled by it.  Only
these are used on the driver; every page is parsed and decided where it lies.

A block is the text between two block boundaries; inline elements do not end one and a
line break counts as white space.  NULL html is an empty page with an empty text.
Broken markup is read as far as it goes: end tags without a start are ignored, open
elements end with the page.  An empty table gives an empty result; repeated rows
are extracted each; added columns replace columns of the same name.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.llm.rowwise import with_columns_of

#: Labelled pages taken from the table at most.
SAMPLE = 100

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose insides are never text of the page.
SKIPPED = set("script style title textarea noscript template iframe svg math object select button canvas audio video head".split())
RAW = set("script style title textarea iframe".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening element ends, and the element that it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
} | {h: (HEADINGS, BLOCKS - HEADINGS) for h in HEADINGS}

#: Where a token begins, with a tag's name; comments and such are whole.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)", re.S)
#: Tokens that the end of the page closes.
UNCLOSED = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
#: Inside a tag: its end, or the start of a quoted value, or a whole plain value.
STOP = re.compile(r">|=\s*(?:([\"'])|[^\s>]*)")
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
NAMED = {"class", "id", "role", "itemprop", "aria-label"}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

HINTS = {
    "content": "article articlebody post content entry story main body text blog prose page",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "head": "header masthead banner topbar logo branding head top",
    "foot": "footer foot copyright bottom legal colophon",
    "side": "sidebar aside side rail widget related recommended recirculation trending complementary more popular",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay toast privacy paywall message warning",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted outbrain taboola",
    "form": "form search login signup signin register newsletter subscribe subscription contact",
    "comment": "comment comments commentlist reply replies disqus discussion respond reader readers feedback",
    "share": "share sharing social follow tags tagcloud meta byline author",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
GROUPS = {
    "article": "article main", "nav": "nav menu", "header": "header hgroup", "footer": "footer address", "aside": "aside dialog details",
    "form": "form fieldset legend", "p": "p blockquote pre", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd",
    "table": "table tbody thead tfoot tr td th caption", "div": "div section center", "figure": "figure figcaption", "page": "html", "body": "body",
}
GROUP_OF = {t: g for g, tags in GROUPS.items() for t in tags.split()}
FEATURES = [*[f"tag {g}" for g in GROUPS], *[f"hint {h}" for h in HINTS], "hidden", "empty", "words 1", "words 5", "words 15", "links", "ended", "rights"]
INDEX = {f: i for i, f in enumerate(FEATURES)}
#: Kinds of edges by the child: plain, named like something beside the text, named like the text.
PLAIN, ASIDE, CENTRE = range(3)
AWAY = {"nav", "header", "footer", "aside", "form"}


@dataclass
class Page:
    """Block elements in page order, and the blocks of text with the element that holds each."""

    parent: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    edge: list[int] = field(default_factory=list)
    own: list[list[str]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


_SEEN: dict[tuple[str, str], tuple[list[int], int]] = {}


def element(tag: str, attributes: str) -> tuple[list[int], int]:
    """Features and edge kind that an element has by its name and attributes."""
    key = (tag, attributes)
    if key in _SEEN:
        return _SEEN[key]
    group = GROUP_OF.get(tag, "div")
    found = [INDEX[f"tag {group}"]]
    hints: set[str] = set()
    pairs = [(name.lower(), value) for name, value in ATTRIBUTE.findall(attributes)]
    for name, value in pairs:
        if name in NAMED:
            hints.update(HINT_OF[w.lower()] for w in PART.findall(value) if w.lower() in HINT_OF)
    found += [INDEX[f"hint {h}"] for h in sorted(hints)]
    # Markup or data in other values says nothing about the element.
    said = " ".join(f"{name}={value}" for name, value in pairs if name in NAMED or name in ("hidden", "style", "aria-hidden"))
    concealed = HIDDEN.search(said) is not None
    if concealed:
        found.append(INDEX["hidden"])
    # The head of a post or an article holds its title; that of a page does not.
    own = {"content", "share", "head"} if "content" in hints else {"share"}
    away = group in AWAY or concealed or bool(hints - own)
    made = found, ASIDE if away else CENTRE if group == "article" or "content" in hints else PLAIN
    if len(_SEEN) < 10_000 and len(attributes) < 1_000:
        _SEEN[key] = made
    return made


def tag_end(source: str, at: int, dead: set[int]) -> int:
    """The place of the ">" that ends a tag whose name ends at ``at``: the first outside quoted values, of any length.

    Where a quote never closes it is the next ">".  ``dead`` keeps the quotes from which no end was found,
    so that none is followed twice and a page takes linear time.
    """
    begun, i = [], at
    while (m := STOP.search(source, i)) is not None:
        if m[0] == ">":
            return m.start()
        i = m.end()
        if m[1]:
            if i in dead:
                break
            begun.append(i)
            i = source.find(m[1], i) + 1
            if not i:
                break
    dead.update(begun)
    return source.find(">", at)


def parse(source: str) -> Page:
    """The block elements and blocks of a page."""
    page = Page()
    stack: list[int] = []
    open_tags: dict[str, int] = {}
    run: list[str] = []
    links = at = 0

    def push(tag: str, attributes: str) -> None:
        features, edge = element(tag, attributes)
        page.parent.append(stack[-1] if stack else -1)
        page.names.append(tag)
        page.features.append(list(features))
        page.edge.append(edge)
        page.own.append([])
        page.linked.append(0)
        stack.append(len(page.names) - 1)
        open_tags[tag] = open_tags.get(tag, 0) + 1

    def pop() -> None:
        open_tags[page.names[stack.pop()]] -= 1

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                page.blocks.append((stack[-1], text))
                page.own[stack[-1]].append(text)

    def close(names: set[str], until: set[str]) -> None:
        """Ends the innermost open element of ``names``, unless one of ``until`` is inside it."""
        if not any(open_tags.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if page.names[stack[depth]] in names:
                while len(stack) > depth:
                    pop()
                return
            if page.names[stack[depth]] in until:
                return

    push("html", "")
    skip = ""
    depth = 0
    size, final = len(source), source.rfind(">")
    dead: set[int] = set()
    while at < size:
        m = TOKEN.search(source, at) if final >= at else None
        if m and m[1] and m.end() > final:
            m = UNCLOSED.search(source, m.start())
        if not skip and (m is None or m.start() > at):
            piece = source[at : m.start() if m else size]
            run.append(piece)
            if links and not piece.isspace():
                page.linked[stack[-1]] += len(piece)
        if m is None:
            break
        at = m.end()
        tag = (m[1] if m.re is TOKEN and m[1] else "").lower()
        if not tag:
            continue
        ending = source[m.start() + 1] == "/"
        stop = tag_end(source, at, dead)
        attributes, at = source[at:stop], stop + 1
        if skip:
            # Inside a skipped element only its own tags count; the body ends an open head.
            if tag == skip:
                depth += -1 if ending else 1
            if depth == 0 or (skip == "head" and tag == "body"):
                skip = ""
            if tag != "body":
                if tag in RAW and not ending:
                    shut = re.compile(f"</{tag}", re.I).search(source, at)
                    at = shut.start() if shut else size
                continue
        if tag in SKIPPED:
            if not ending and not attributes.endswith("/"):
                if tag not in ("svg", "math", "button", "canvas", "select"):
                    flush()
                skip, depth = tag, 1
                if tag in RAW:
                    shut = re.compile(f"</{tag}", re.I).search(source, at)
                    at = shut.start() if shut else size
        elif tag in BLOCKS:
            flush()
            if ending:
                if tag == "p" and not open_tags.get("p"):
                    continue
                close({tag}, set() if tag not in ("p", *HEADINGS) else {"article", "main", "body"})
            elif tag in ("html", "body") and open_tags.get(tag):
                continue
            else:
                if open_tags.get("p"):
                    close({"p"}, BLOCKS - {"p"})
                if tag in ENDS:
                    close(*ENDS[tag])
                if tag not in VOID:
                    push(tag, attributes)
        elif tag == "a":
            links = 0 if ending else 1
        elif tag == "br":
            run.append(" ")
    flush()
    for i, texts in enumerate(page.own):
        _describe(page.features[i], texts, page.linked[i])
    return page


def _describe(features: list[int], texts: list[str], linked: int) -> None:
    """Adds the features of an element's own text."""
    if not texts:
        features.append(INDEX["empty"])
        return
    words, chars = sum(t.count(" ") + 1 for t in texts), sum(map(len, texts))
    features.append(INDEX["words 1" if words < 5 else "words 5" if words < 15 else "words 15"])
    if 2 * linked > chars:
        features.append(INDEX["links"])
    if texts[-1][-1] in ".!?…:;\"'”’»)":
        features.append(INDEX["ended"])
    if any("©" in t or "copyright" in t.lower() or "all rights reserved" in t.lower() for t in texts):
        features.append(INDEX["rights"])


@dataclass(frozen=True)
class Model:
    """Weights of the nodes' features, and log potentials of edges by kind, parent's and child's state."""

    node: np.ndarray
    edge: np.ndarray

    def marginals(self, page: Page) -> list[float]:
        return _pass(page, self.node.tolist(), np.exp(self.edge).tolist())[0]


LIMIT = 1e60


def _pass(page: Page, weights: list[float], tables: list, edges: bool = False) -> tuple[list[float], list]:
    """Sum-product on the tree of a page: marginals of nodes and, if asked for, of edges.

    Messages are odds of content against not; parents come before their children in page order.
    """
    parent, kind = page.parent, page.edge
    n = len(parent)
    up = [math.exp(max(-60.0, min(60.0, sum([weights[f] for f in fs])))) for fs in page.features]
    sent = [1.0] * n
    for i in range(n - 1, 0, -1):
        (w00, w01), (w10, w11) = tables[kind[i]]
        r = up[i]
        sent[i] = (w10 + w11 * r) / (w00 + w01 * r)
        p = parent[i]
        up[p] = min(LIMIT, max(1 / LIMIT, up[p] * sent[i]))
    odds = up[:]
    pairs = []
    for i in range(1, n):
        (w00, w01), (w10, w11) = tables[kind[i]]
        q = odds[parent[i]] / sent[i]
        odds[i] = min(LIMIT, max(1 / LIMIT, up[i] * (w01 + w11 * q) / (w00 + w10 * q)))
        if edges:
            r = up[i]
            joint = (w00, w01 * r, w10 * q, w11 * q * r)
            total = sum(joint)
            pairs.append([j / total for j in joint])
    return [o / (1 + o) for o in odds], pairs


def train(pages: list[tuple[Page, list[int]]], steps: int = 200, rate: float = 0.1, decay: float = 0.0001) -> Model:
    """Weights by gradient ascent on the conditional log likelihood of labelled pages (labels of nodes)."""
    theta = np.zeros(len(FEATURES) + 12)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n_nodes = sum(len(labels) for _, labels in pages)
    for step in range(1, steps + 1):
        weights, tables = theta[: len(FEATURES)].tolist(), np.exp(theta[len(FEATURES) :].reshape(3, 2, 2)).tolist()
        slope = np.zeros_like(theta)
        for page, labels in pages:
            p, pairs = _pass(page, weights, tables, edges=True)
            for i, fs in enumerate(page.features):
                d = labels[i] - p[i]
                for f in fs:
                    slope[f] += d
            for i in range(1, len(labels)):
                at = len(FEATURES) + 4 * page.edge[i]
                slope[at + 2 * labels[page.parent[i]] + labels[i]] += 1
                slope[at : at + 4] -= pairs[i - 1]
        slope = slope / n_nodes - decay * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(3, 2, 2))


def labels_by(page: Page, inside: list[bool]) -> list[int]:
    """States of the nodes: content where ``inside`` holds for the node or an ancestor and no node from there on leads away."""
    state = [0] * len(page.parent)
    for i in range(1, len(state)):
        state[i] = int((state[page.parent[i]] or inside[i]) and page.edge[i] != ASIDE)
    return state


def by_markup(source: str) -> tuple[Page, list[int]] | None:
    """A page labelled by its one article or main element; None where there is no such one."""
    page = parse(source)
    centre = [n in ("article", "main") for n in page.names]
    return (page, labels_by(page, centre)) if sum(centre) == 1 else None


def layouts(n: int = 80, seed: int = 7) -> list[tuple[Page, list[int]]]:
    """Labelled pages put together from parts: an article of paragraphs, lists and tables, with other parts around and inside it."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def menu(tag: str, attributes: str) -> str:
        return f"<{tag} {attributes}><ul>" + "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(rng.randint(3, 8))) + f"</ul></{tag}>"

    def part(tag: str, attributes: str) -> str:
        inner = rng.choice([words(3, 30) + ".", f"<p>{words(2, 40)}.</p>", f"<p>{words(1, 9)}</p><p>{words(8, 40)}.</p>", f"<h3>{words(1, 4)}</h3><ul><li>{words(2, 9)}</li><li>{words(1, 5)}.</li></ul>"])
        return f"<{tag} {attributes}>{inner}</{tag}>"

    def named(hint: str) -> str:
        return f'{rng.choice(["class", "id"])}="{rng.choice(HINTS[hint].split())}{rng.choice(["", " box", "-1"])}"'

    def beside() -> str:
        kind = rng.choice(["nav", "head", "foot", "side", "notice", "ad", "form", "comment"])
        if kind == "nav":
            return menu(rng.choice(["nav", "div"]), named("nav"))
        tag = {"head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        return part(rng.choice([tag, "div", "section"]), "hidden" if rng.random() < 0.1 else named(kind))

    def plain() -> str:
        return rng.choice([menu("nav", ""), part("header", ""), part("footer", ""), part("aside", ""), part("form", "")])

    def body() -> str:
        out = [f"<h1>{words(2, 10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(2, 9)):
            out.append(rng.choice([
                lambda: f"<p>{words(1, 60)}.</p>", lambda: f"<p>{words(1, 3)}.</p>", lambda: f"<p>{words(10, 60)}</p>", lambda: f"<h2>{words(1, 5)}</h2><p>{words(5, 50)}.</p>",
                lambda: f"<ul><li>{words(1, 12)}</li><li>{words(2, 9)}.</li></ul>", lambda: f"<blockquote><p>{words(4, 25)}.</p></blockquote>",
                lambda: f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", lambda: f"<div><p>{words(4, 40)}.</p></div>",
                lambda: f'<p><a href="#">{words(2, 6)}</a> {words(0, 30)}.</p>', beside if rng.random() < 0.3 else lambda: f"<p>{words(5, 50)}.</p>",
            ])())
        return "".join(out)

    made = []
    for _ in range(n):
        tag, attributes = rng.choice([("article", ""), ("main", ""), ("article", named("content")), ("div", named("content")), ("section", named("content")), ("div", ""), ("body", ""), ("body", "")])
        around = [rng.choice([beside, plain])() for _ in range(rng.randint(2, 5))]
        cut = rng.randint(0, len(around))
        if tag == "body":
            around = ["".join(around[:cut]), body(), "".join(around[cut:])]
            centre = f"<body data-centre>{''.join(around)}</body>"
        else:
            centre = f"<{tag} {attributes} data-centre>{body()}</{tag}>"
            if rng.random() < 0.5:
                centre = f"<div>{centre}</div>"
            centre = f"<body>{''.join(around[:cut])}{centre}{''.join(around[cut:])}</body>"
        source = f"<html>{centre}</html>"
        made.append(_labelled(source))
    for _ in range(n // 2):
        # The text stands in no paragraph: in the body itself, a cell, or one container for all of it.
        text = "<br>".join(words(6, 90) + rng.choice([".", ".", ""]) for _ in range(rng.randint(1, 3)))
        title = rng.choice(["", "", f"<h1>{words(2, 8)}</h1>", f"<h2>{words(2, 8)}</h2>"])
        box = rng.choice(["{0}{1}", "{0}{1}", "<center>{0}{1}</center>", "{0}<pre>{1}</pre>", "{0}<div>{1}</div>", "{0}<table><tr><td>{1}</td></tr></table>", "<table><tr><td>{0}{1}</td></tr></table>"])
        around = [rng.choice([beside, plain])() for _ in range(rng.randint(0, 2))]
        cut = rng.randint(0, len(around))
        made.append(_labelled(f"<html><body data-centre>{''.join(around[:cut])}{box.format(title, text)}{''.join(around[cut:])}</body></html>"))
    for _ in range(n // 4):
        # The title of an article in a box of its own.
        box = f'<div class="{rng.choice(["post", "entry", "article", "content", "story"])}-{rng.choice(["header", "head", "top"])}"><h1>{words(2, 9)}</h1></div>'
        around = [rng.choice([beside, plain])() for _ in range(rng.randint(1, 3))]
        made.append(_labelled(f"<html><body>{around[0]}<article data-centre>{box}{body()}</article>{''.join(around[1:])}</body></html>"))
        # An article of a few words, on a page without more of a frame.
        short = "".join(rng.choice([f"<p>{words(1, 4)}.</p>", f"<p>{words(1, 4)}</p>", beside()]) for _ in range(rng.randint(1, 3)))
        made.append(_labelled(f"<html>{around[0]}<article data-centre><p>{words(1, 4)}.</p>{short}</article>{''.join(around[1:])}</html>"))
    return made


def _labelled(source: str) -> tuple[Page, list[int]]:
    """A page labelled by the element that carries the mark of the centre."""
    page = parse(source)
    inside = [False] * len(page.names)
    inside[_marked(source, page)] = True
    return page, labels_by(page, inside)


def _marked(source: str, page: Page) -> int:
    """The number of the element that carries the mark of the centre."""
    before = source[: source.index("data-centre")]
    return len(parse(before[: before.rindex("<")]).names)


def extract(source: str, model: Model) -> str:
    """The main text of a page."""
    page = parse(source)
    keep = [p > 0.5 for p in model.marginals(page)]
    return "\n".join([text for i, text in page.blocks if keep[i]])


def fitted(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from LAYOUTS and up to ``sample`` pages of the table that their markup labels."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    # The ids are settled first, so that no task sends more pages than are taken.
    ids = [r[0] for r in marked.where("page_id IS NOT NULL").select("page_id").orderBy("page_id").limit(sample).collect()]
    some = marked.where(F.col("page_id").isin(ids)).orderBy("page_id", "html").select("html").limit(sample).collect()
    return train([*layouts(), *[x for r in some if (x := by_markup(r["html"])) is not None]])


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages`` with ``text`` in place of ``html``, and ``n_chars``."""
    known = model or fitted(pages)
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def start():
        def one(source: str) -> tuple[str, int]:
            text = extract(source, known)
            return text, len(text)

        return one

    return with_columns_of(pages, "html", fields, start).drop("html")
