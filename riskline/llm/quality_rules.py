"""Line-first cleaning: rules decide about lines, then about what is left of the document.

Each line with a word is held against three kinds of rules.

punctuation  it ends without a closing mark and holds no ended sentence, or too many of its characters are
             symbols, or nearly every word carries an exclamation or question mark
navigation   separators stand between most of its words, or it is a short line
             that begins like a menu entry
boilerplate  it holds a fixed phrase of notices

Lines that fail are removed.  A document is rejected if it fails the base limits
on words and repeated windows, or if the removed lines hold too large a share
of its characters.  Everything is an expression on one row: no shuffle, no
Python, and a hot source or a long text costs its own length only.

NULL text counts as empty and is rejected; repeated rows get the same verdict
each; an empty table gives an empty result; other columns pass unchanged, and
those the operator adds replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.text import SPACE, WORD, fresh, has_word, let, lines, solid, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "n_lines_removed")
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|›»•·>"
CLOSING = ".!?:;…\"'”’»)]。！？"
ENDED = r"[.!?…。！？][ \t-\r]"
MENU = r"(?i)^[ \t-\r]*(home|menu|next|previous|back|login|log in|sign in|sign up|register|search|skip to content|contact us|about us)\b"
NOTICE = (
    r"(?i)\b(all rights reserved|cookie policy|privacy policy|terms of use|terms of service|accept all cookies|use cookies|"
    r"enable javascript|lorem ipsum|subscribe to our|click here|share on facebook|share on twitter|powered by)\b"
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_symbol_percent: int = 10
    max_shout_percent: int = 50
    separator_percent: int = 25
    menu_words: int = 4
    max_lost_percent: int = 40


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` belong to ``chars``; most texts have none and are scanned once."""
    group = "[" + chars.replace("|", r"\|") + "]"
    return F.when(text.rlike(group), F.regexp_count(text, F.lit(group))).otherwise(F.lit(0))


def line_fails(line: Column, r: Rules) -> Column:
    """Whether a line that has a word fails a rule."""
    closed = F.substring(F.rtrim(line, F.lit(SPACE)), -1, 1).isin(list(CLOSING)) | line.rlike(ENDED)
    n = F.regexp_count(line, F.lit(WORD))
    symbols = let(count_of(line, SYMBOLS), lambda k: (k > 0) & (k * 100 > F.length(solid(line)) * r.max_symbol_percent))
    shouts = let(count_of(line, "!?"), lambda k: (k >= 2) & (n >= 4) & (k * 100 > n * r.max_shout_percent))
    menu = let(count_of(line, SEPARATORS), lambda k: (k >= 2) & (k * 100 >= n * r.separator_percent))
    entry = line.rlike(MENU) & (n <= r.menu_words)
    return ~closed | symbols | shouts | menu | entry | line.rlike(NOTICE)


def repeated_window_words(tokens: Column, size: int) -> Column:
    """Words inside windows of ``size`` words that stand at two or more places of the text.

    Windows are compared by a 64-bit hash within their own text: two different ones
    would agree in about one of 10^13 texts of 1,000 words.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (size - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))

    def covered(v: Column) -> Column:
        def repeats(o: Column) -> Column:
            some = F.filter(o, lambda x, k: F.coalesce((F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"]), F.lit(False)))
            return F.sort_array(F.transform(some, lambda x: x["i"]))

        def spans(at: Column) -> Column:
            step = F.transform(at, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - p, F.lit(size))))
            return F.aggregate(step, F.lit(0), lambda s, x: s + x)

        ordered = F.sort_array(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(ordered, repeats), spans)

    def decide(ws: Column) -> Column:
        hashed = let(F.transform(ws, lambda w: F.xxhash64(w)), windows)
        return let(hashed, lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), covered(v)).otherwise(F.lit(0)))

    return F.when(F.size(tokens) > size, let(tokens, decide)).otherwise(F.lit(0))


def verdict(text: Column, rules: Rules = Rules()) -> Column:
    """All counts of a text and the decision on it, as one struct."""
    body = F.coalesce(text, F.lit(""))

    def counts(tokens: Column, solid_lines: Column, failing: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("bigint").alias("n_words"),
            F.length(solid(body)).cast("bigint").alias("word_chars"),
            count_of(body, SYMBOLS).cast("bigint").alias("n_symbols"),
            (F.size(solid_lines) - F.size(F.array_distinct(solid_lines))).cast("bigint").alias("n_dup_lines"),
            repeated_window_words(tokens, rules.window).cast("bigint").alias("n_repeat_words"),
            F.aggregate(failing, F.lit(0), lambda n, x: n + F.length(solid(x))).cast("bigint").alias("lost_chars"),
            F.size(failing).cast("bigint").alias("n_lines_removed"),
        )

    def decide(m: Column) -> Column:
        base = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
        kept = ~base & (100 * m["lost_chars"] <= rules.max_lost_percent * m["word_chars"])
        return F.struct(*[m[c].alias(c) for c in COUNTS], base.alias("base_failed"), kept.alias("kept"))

    solid_lines = F.filter(lines(body), has_word)
    return let(
        let(words(body), lambda t: let(solid_lines, lambda a: let(F.filter(a, lambda x: line_fails(x, rules)), lambda f: counts(t, a, f)))),
        decide,
    )


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the counts, the verdict (``kept``) and the cleaned text (``clean_text``)."""
    name = fresh(docs.columns, "verdict")
    out = docs.withColumn(name, verdict(F.col("text"), rules))
    fields = [F.col(name)[c].alias(c) for c in (*COUNTS, "base_failed", "kept")]
    own = {c.lower() for c in (*COUNTS, "base_failed", "kept", "clean_text")}
    return out.select(*[F.col(c) for c in docs.columns if c.lower() not in own], *fields, cleaned(F.col("text"), rules).alias("clean_text"))


def cleaned(text: Column, rules: Rules = Rules()) -> Column:
    """The text without its failing lines; lines without a word stay."""
    return F.array_join(F.filter(lines(text), lambda x: ~has_word(x) | ~line_fails(x, rules)), "\n")


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, in the columns they came with, with cleaned texts.

    ``n_chars``, if there, follows the text.
    """
    text = cleaned(F.col("text"), rules)
    kinds = dict(docs.dtypes)
    new = {"text": text, "n_chars": F.length(text).cast(kinds.get("n_chars", "bigint"))}
    return docs.where(verdict(F.col("text"), rules)["kept"]).select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
