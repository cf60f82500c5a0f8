"""Shared column expressions: the word rule, ASCII lower case, binding a value once."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space between words: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: as a lambda's argument it cannot be inlined again."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text (null: none), in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
