"""Column expressions on text shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six characters that separate words: space and code points 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body names it.

    Inside a lambda an expression is evaluated for every element; a variable bound
    by a one-element array is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; none for NULL, empty or blank texts."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def solid(text: Column) -> Column:
    """The text without its separating characters."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def has_word(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(WORD)


def fresh(taken: list[str], wanted: str) -> str:
    """A column name like ``wanted`` that none of ``taken`` equals, whatever its case."""
    lower = {t.lower() for t in taken}
    name = wanted
    while name.lower() in lower:
        name = f"_{name}"
    return name
