"""URL filter: rules by host and path, and a block list tested with a cascade of Bloom filters.

A listed key is a host name; it blocks that host and its subdomains.  The key universe of a
corpus is every host in it with its parent domains, down to the number of labels that the deepest listed
key has.  Level 1 of the cascade encodes the listed keys of the universe, level 2 the unlisted
ones that level 1 takes for listed, level 3 the listed ones that level 2 takes for unlisted, and
so on until a level has no false positive left.  Every level hashes anew.  A key of the universe
is decided at the first level that does not hold it, or by the last level, so membership is
exact for the whole corpus, and judging a page needs no join: a level is an array of words
that a scalar subquery hands to every task, and a key is tested by a few bits of one word.

A cascade takes some ``BITS`` bits for each listed key, and little for further levels.  Keys
are dealt by hash to as many cascades as keep each under ``MOST`` bits; with more than one
the slim rows are written between passes, so a task never holds more than one.

Results for odd input: a NULL url, or one without ``://``, has an empty host and path, matches
no rule and is allowed.  Empty labels and ports are kept as they stand.  Repeated rows are judged
alike; empty tables give empty results; other columns pass, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.operators.lineage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a level for each of its keys, bits that a key sets in its word, and the bits that one level may have.
BITS, SET, MOST = 12, 4, 1 << 27
#: Labels of the names that are listed by the words in them.
DEPTH = 5


def with_parts(pages: DataFrame, host: str = "host", path: str = "path", url: str = "url") -> DataFrame:
    """``pages`` with the lower-cased (A-Z) host of the url and its path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns(
        {
            host: F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            path: F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        }
    )


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the urls of a host and its subdomains whose path starts with the rule's."""

    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        start = "/" + rest if "/" in self.text else ""
        return ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))


def decided(rules: Iterable[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; NULL where none fits.  Equally long ones go by text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = r.fits(host, path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def parent(host: Column, labels: int) -> Column:
    """The last ``labels`` labels of a host; the host itself if it has no more."""
    return F.substring_index(host, ".", -labels)


def universe(pages: DataFrame, labels: int, host: str = "host") -> DataFrame:
    """The distinct keys of the corpus: hosts and parent domains of up to ``labels`` labels."""
    keys = F.array_distinct(F.array(*[parent(F.col(host), i) for i in range(1, labels + 1)]))
    return pages.where(F.col(host) != "").select(F.explode(keys).alias("key")).distinct()


def named(pages: DataFrame, words: Sequence[str], labels: int = DEPTH, host: str = "host") -> DataFrame:
    """The ``key`` of every host name of up to ``labels`` labels in the corpus whose first label has one of ``words`` between hyphens."""
    return universe(pages, labels, host).where(F.col("key").rlike(rf"^([^.]*-)?({'|'.join(words)})(-[^.]*)?([.]|\z)"))


def _place(key: Column, level: int, words: int) -> Column:
    """The word of a filter that a key sets bits of."""
    return F.pmod(F.xxhash64(F.lit(level), key), F.lit(words))


def _mask(key: Column, level: int) -> Column:
    """The bits that a key sets."""
    h, one = F.xxhash64(key, F.lit(level)), F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(SET)]
    return reduce(Column.bitwiseOR, bits)


@dataclass(frozen=True)
class Level:
    """One filter: its number, its words, and a table with the one row that holds them as an array of longs."""

    number: int
    words: int
    table: DataFrame

    def holds(self, key: Column) -> Column:
        word, mask = F.get(self.table.scalar(), _place(key, self.number, self.words).cast("int")), _mask(key, self.number)
        return word.bitwiseAND(mask) == mask


def _encoded(keys: DataFrame, number: int, n: int) -> Level:
    """The level with the ``n`` keys of ``keys``; its words are as many as MOST allows at the utmost, and meet in one row."""
    words = max(1, n * BITS // 64)
    bits = keys.select(_place(F.col("key"), number, words).alias("at"), _mask(F.col("key"), number).alias("bits"))
    none = keys.sparkSession.range(words).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("bits"))
    dense = bits.union(none).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    row = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("words"))
    return Level(number, words, written(row, "filter"))


@dataclass(frozen=True)
class Cascade:
    """Levels that decide the membership of every key they were made from."""

    levels: tuple[Level, ...]

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for v in reversed(self.levels):
            out = F.when(v.holds(key), out).otherwise(F.lit(v.number % 2 == 0))
        return out


def cascade(keys: DataFrame) -> Cascade:
    """The cascade of ``keys`` (key, listed), which should be a written table of distinct keys."""
    levels: list[Level] = []
    inside, outside = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
    while n := inside.count():
        level = _encoded(inside, len(levels) + 1, n)
        levels.append(level)
        inside, outside = written(outside.where(level.holds(F.col("key"))), "taken"), inside
    return Cascade(tuple(levels))


def marked_keys(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) of the universe ``keys``, written."""
    both = keys.select("key", F.lit(False).alias("listed"), F.lit(True).alias("seen")).union(
        listed.select("key", F.lit(True), F.lit(False))
    )
    marked = both.groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen"))
    return written(marked.where("seen").select("key", "listed"), "keys")


def with_listed(pages: DataFrame, listed: DataFrame, name: str, host: str = "host") -> DataFrame:
    """``pages`` with a flag: whether its host or a parent domain is among the ``key`` of ``listed``.

    ``listed`` is read twice: for the labels of its deepest key, and for the universe.
    """
    labels = listed.agg(F.max(F.size(F.split("key", r"\."))).alias("n")).first()["n"] or 1
    keys = marked_keys(universe(pages, labels, host), listed)
    n = keys.where("listed").count()
    parts = max(1, -(-n * BITS // MOST))
    dealt = lambda key: F.pmod(F.xxhash64(F.lit(0), key), F.lit(parts))
    out = pages.withColumn(name, F.lit(False))
    for part in range(parts):
        made = cascade(keys.where(dealt(F.col("key")) == part) if parts > 1 else keys)
        found = F.col(name)
        for i in range(1, labels + 1):
            key = parent(F.col(host), i)
            found = found | ((made.member(key) if parts == 1 else (dealt(key) == part) & made.member(key)) & (F.col(host) != ""))
        out = out.withColumn(name, found)
        if part + 1 < parts:
            out = written(out, "judged")
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame | None = None, words: Sequence[str] = ()) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A page goes by the longest fitting rule, else it is blocked if its host or a parent
    domain is listed.  ``listed`` has a column ``key``; without it the host names of the corpus with one of
    ``words`` in their first label are listed.
    """
    new = ("host", "path", "rule", "verdict")
    names = [c for c in pages.columns if c.lower() not in new]
    held = {c: c if c == "url" else f"c{i}" for i, c in enumerate(pages.columns)}
    parts = with_parts(pages.toDF(*held.values())).select(*[held[c] for c in names], "host", "path")
    if listed is None:
        listed = written(named(parts, words), "listed")
    marked = with_listed(parts, listed, "_listed")
    rule, verdict = decided(rules, F.col("host"), F.col("path"))
    other = F.when(F.col("_listed"), "block").otherwise("allow")
    return marked.select(
        *[F.col(held[c]).alias(c) for c in names], "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict")
    )
