"""Removal of runs of lines that stand earlier in the corpus, found by winnowing over line hashes.

A window is the shortest run of worded lines from a line on that has ``words``
words or ``lines`` lines.  Each window selects the smallest hash among its lines;
these minima are the fingerprints.  Two equal runs that hold a window select
the same lines of it, so every repeated run of that size shares a fingerprint
(winnowing's guarantee).  Places with a fingerprint that occurs once are done.
From the others matches grow both ways: back to the start of their window, and
forward to every line up to where the next window would take over.  A run that
equals one at an earlier place (smaller doc_id, or earlier in the document)
is deleted; of each passage the first occurrence stays.

What is removed depends on line contents and order only: exactly the lines
covered by a run of that size which occurs earlier.  Equality is that of the
lines without white space at their ends, by 128-bit hash.  A document makes at
most two runs a line, groups are reduced to their first place by a combining
aggregate before anything is joined, and no pairs of places are made.

Lines without a word never match and stay.  NULL text counts as empty.  NULL
doc_ids come last in order.  Rows that agree in doc_id and text are one
document: they lose the same lines.  An empty table stays empty; other columns
pass unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.text import SPACE, WORD, fresh, has_word, let, lines
from riskline.operators.lineage import written


@dataclass(frozen=True)
class Window:
    words: int = 6
    lines: int = 2


def _end(a: Column, i: Column, w: Window) -> Column:
    """Index of the last line of the window that begins at ``i``; NULL if the text ends before."""
    total, at = F.get(a, i)["n"], F.when(F.get(a, i)["n"] >= w.words, i)
    for k in range(1, w.lines):
        total = total + F.get(a, i + k)["n"]
        at = at.when(total >= w.words, i + k)
    return at.when(F.size(a) >= i + w.lines, i + (w.lines - 1))


def _run(a: Column, start: Column, end: Column) -> Column:
    return F.unhex(F.md5(F.array_join(F.transform(F.slice(a, start + 1, end - start + 1), lambda x: x["h"]), "")))


def windows(docs: DataFrame, w: Window = Window()) -> DataFrame:
    """One row per window: its document, its first line, its fingerprint with place, and the runs that it begins."""
    whole = F.transform(lines(F.col("text")), lambda x, p: F.struct(p.alias("p"), x.alias("x")))
    worded = F.transform(
        F.filter(whole, lambda s: has_word(s["x"])),
        lambda s: F.struct(s["p"].alias("p"), F.md5(F.trim(s["x"], F.lit(SPACE))).alias("h"), F.regexp_count(s["x"], F.lit(WORD)).alias("n")),
    )

    def begun(a: Column) -> Column:
        ends = F.transform(a, lambda x, i: F.struct(i.alias("s"), _end(a, i, w).alias("e"), _end(a, i + 1, w).alias("f")))

        def one(v: Column) -> Column:
            inside = F.slice(a, v["s"] + 1, v["e"] - v["s"] + 1)
            least = F.array_min(F.transform(inside, lambda x: F.struct(x["h"].alias("h"), x["p"].alias("p"))))
            reach = F.greatest(v["e"], F.coalesce(v["f"], F.size(a)) - 1)
            runs = F.transform(
                F.sequence(v["e"], reach), lambda j: F.struct(F.get(a, j)["p"].alias("last"), _run(a, v["s"], j).alias("run"))
            )
            return F.struct(
                F.get(a, v["s"])["p"].alias("first"), F.unhex(least["h"]).alias("mark"), least["p"].alias("mark_at"), runs.alias("runs")
            )

        return F.transform(F.filter(ends, lambda v: v["e"].isNotNull()), one)

    return docs.select("doc_id", F.xxhash64("text").alias("body"), F.explode(let(worded, begun)).alias("v")).select("doc_id", "body", "v.*")


def place(at: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("body").alias("b"), F.col(at).alias("p"))


def repeated_lines(docs: DataFrame, w: Window = Window()) -> DataFrame:
    """(doc_id, body, gone): the numbers of the lines to remove, one row per document that loses any.

    ``body`` is the hash of the text.
    """
    found = written(windows(docs, w), "windows")
    marks = found.groupBy("mark").agg(F.min(place("mark_at")).alias("a"), F.max(place("mark_at")).alias("z")).where("a <> z").select("mark")
    # Written, so that the joins are between plain exchanges and Spark can split the hot keys of their left sides.
    marks = written(marks, "marks")
    grown = found.join(marks, "mark", "left_semi").select("doc_id", "body", "first", F.explode("runs").alias("r"))
    runs = written(grown.select("doc_id", "body", "first", "r.last", "r.run"), "runs")
    firsts = runs.groupBy("run").agg(F.min(place("first")).alias("a"), F.max(place("first")).alias("z")).where("a <> z").select("run", "a")
    firsts = written(firsts, "firsts")
    later = runs.join(firsts, "run").where(place("first") > F.col("a"))
    spans = later.groupBy("doc_id", "body", "first").agg(F.max("last").alias("last"))
    gone = F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last"))))
    return spans.groupBy("doc_id", "body").agg(gone.alias("gone"))


def dedup(docs: DataFrame, w: Window = Window()) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` and ``n_lines_removed`` (lines with a word)."""
    new = ("clean_text", "n_lines", "n_lines_removed")
    names = [c for c in docs.columns if c.lower() not in new]
    body, key, other, gone = (fresh(docs.columns, f"_{c}") for c in ("body", "key", "other", "gone"))
    cut = repeated_lines(docs, w).toDF(key, other, gone)
    all_lines = lines(F.col("text"))

    def lost(a: Column) -> Column:
        return F.filter(F.col(gone), lambda p: has_word(F.get(a, p)))

    def left(a: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), lost(a)), lambda p: F.get(a, p)), "\n")

    # Only documents that lose lines are on the other side, so its hash table holds a small share of the rows.
    held = docs.withColumn(body, F.xxhash64("text"))
    joined = held.join(cut.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(body) == F.col(other)), "left")
    kept = F.col(gone).isNull()
    return joined.select(
        *names,
        F.when(kept, F.coalesce(F.col("text"), F.lit(""))).otherwise(let(all_lines, left)).alias("clean_text"),
        F.size(F.filter(all_lines, has_word)).cast("bigint").alias("n_lines"),
        F.when(kept, F.lit(0)).otherwise(F.size(let(all_lines, lost))).cast("bigint").alias("n_lines_removed"),
    )


def keep_first(docs: DataFrame, w: Window = Window()) -> DataFrame:
    """The documents in the columns they came with, without repeated runs; those of which nothing is left go.

    ``n_chars``, if there, follows the text.
    """
    kinds = dict(docs.dtypes)
    held = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    marked = dedup(docs.toDF(*held.values()), w).where("n_lines_removed = 0 OR n_lines_removed < n_lines")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(kinds.get("n_chars", "bigint"))}
    return marked.select(*[new.get(c, F.col(held[c])).alias(c) for c in docs.columns])
