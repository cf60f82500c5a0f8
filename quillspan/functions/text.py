"""Column expressions for text, with Unicode white space and code-point offsets throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

SPACE = r"(?U)\s+"


def words(text: Column) -> Column:
    """Words between runs of white space, no empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(words(text), " ")


def normalized(text: Column) -> Column:
    """Lower case, white space collapsed, ends stripped."""
    return collapsed(F.lower(text))


def masked(text: Column) -> Column:
    """Normalized, each run of digits as one 0."""
    return F.regexp_replace(normalized(text), r"(?U)\d+", "0")


def group_hash(text: Column) -> Column:
    """SHA-256 of the collapsed text; the text itself stays as it is."""
    return F.sha2(collapsed(text), 256)


def occurrences(text: Column, what: str) -> Column:
    """Times a literal occurs, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def cut(text: Column, start: Column, end: Column) -> Column:
    """Code points [start, end)."""
    return F.substring(text, start + 1, end - start)


def band(value: Column, edges: list[tuple[int, str]], rest: str) -> Column:
    """The name of the first edge that the value does not pass."""
    return reduce(lambda a, e: a.when(value <= e[0], e[1]), edges[1:], F.when(value <= edges[0][0], edges[0][1])).otherwise(rest)


#: The bands of counts, of counts in audits, of lengths in tokens, of margins and of similarities.
COUNT_BANDS, AUDIT_BANDS = ([(10, "1-10"), (15, "11-15")], "16+"), ([(10, "0-10"), (15, "11-15")], "16+")
LENGTH_BANDS = ([(128, "<=128"), (256, "129-256")], ">256")
MARGIN_BANDS = ([(0.0, "<0"), (2.0, "0-2"), (5.0, "2-5")], ">=5")
SIMILARITY_BANDS = ([(0.5, "0-0.5"), (0.8, "0.5-0.8"), (0.9, "0.8-0.9")], "0.9-1.0")


def band_below(value: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first edge that the value is below."""
    return reduce(lambda a, e: a.when(value < e[0], e[1]), edges[1:], F.when(value < edges[0][0], edges[0][1])).otherwise(rest)


def count_band(value: Column) -> Column:
    return band(value, *COUNT_BANDS)


def shape(word: Column) -> Column:
    """Letter classes of a word (X, x, d), runs collapsed to one."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\p{Nd}", "d")
    return F.regexp_replace(kinds, r"(.)\1+", "$1")


def shingles(text: Column, k: int = 5) -> Column:
    """The distinct runs of k words of a lower-cased text; none if it is shorter."""
    w = words(F.lower(text))
    runs = lambda v: F.when(F.size(v) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(v) - k + 1), lambda i: F.array_join(F.slice(v, i, k), " ")))
    return F.array_distinct(F.transform(F.array(w), runs)[0])


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
