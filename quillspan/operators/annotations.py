"""Profiles of annotated spans: context, region, edges, titles, repeats."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspan.functions.text import cut, words

#: Titles before names.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Sir|Madam"
TITLE_START = rf"(?i)^(?:{TITLES})\.?(?:\s|$)"
TITLE_BEFORE = rf"(?i)\b(?:{TITLES})\.?\s+$"
REFERENCE_LIKE = r"(?i)(?:\d|#|@|/|-{1,2}|\b(?:ref|id|user|acct|ticket|case)\b)"
#: Header lines and closings of letters.
HEADER_LINE = r"(?i)(?:from|to|subject|date|cc)\s*:"
CLOSING = r"(?i)(?:regards|sincerely|thank you|best),?\s*$"


def context(text: Column, start: Column, end: Column, width: int = 42) -> Column:
    """Struct of before, span and after, ``width`` characters to each side at most."""
    low = F.greatest(F.lit(0), start - width)
    return F.struct(cut(text, low, start).alias("before"), cut(text, start, end).alias("span"), cut(text, end, F.least(F.length(text), end + width)).alias("after"))


def region(text: Column, start: Column, end: Column) -> Column:
    """Where a span stands: header, signature_or_tail, opening, paragraph_boundary or body; the first that holds."""
    # Shares of the text, characters looked back, words of a short line.
    n = F.length(text).cast("double")
    before, after = cut(text, F.lit(0), start), cut(text, end, F.length(text))
    head = F.element_at(F.split(before, "\n", -1), -1)
    line = F.concat(head, cut(text, start, end), F.element_at(F.split(after, "\n", -1), 1))
    return (
        F.when((start <= F.greatest(F.lit(1), F.floor(n * 0.12))) & line.rlike(HEADER_LINE), "header")
        .when(F.right(before, F.lit(160)).rlike(CLOSING) | ((start > F.floor(n * 0.72)) & (F.size(words(line)) <= 10)), "signature_or_tail")
        .when(start < F.floor(n * 0.18), "opening")
        .when(F.right(before, F.lit(4)).contains("\n\n") | F.left(after, F.lit(4)).contains("\n\n"), "paragraph_boundary")
        .otherwise("body")
    )


def edge_flags(text: Column, start: Column, end: Column) -> dict[str, Column]:
    """What stands beside and at the ends of a span."""
    left = F.when(start > 0, cut(text, start - 1, start)).otherwise("")
    right, span = cut(text, end, end + 1), cut(text, start, end)
    first, last = F.left(span, F.lit(1)), F.right(span, F.lit(1))
    space, mark = r"(?U)^\s$", r"(?U)^[^\w\s]$"
    return {
        "left_whitespace": left.rlike(space), "right_whitespace": right.rlike(space), "left_punctuation": left.rlike(mark), "right_punctuation": right.rlike(mark),
        "leading_whitespace": first.rlike(space), "trailing_whitespace": last.rlike(space), "leading_punctuation": first.rlike(mark), "trailing_punctuation": last.rlike(mark),
        "internal_newline": span.contains("\n"), "leading_newline": first == "\n", "trailing_newline": last == "\n",
    }


def boundary_profile(spans: DataFrame, text: str = "text") -> DataFrame:
    """(label, count, chars, one count per edge flag)."""
    flags = edge_flags(F.col(text), F.col("start"), F.col("end"))
    return spans.groupBy("label").agg(F.count("*").alias("count"), F.sum(F.col("end") - F.col("start")).alias("chars"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def title_profile(spans: DataFrame, text: str = "text", label: str = "NAME") -> DataFrame:
    """One row: spans of the label that begin with a title, and those right after one (within 30 characters)."""
    span = cut(F.col(text), F.col("start"), F.col("end"))
    near = cut(F.col(text), F.greatest(F.lit(0), F.col("start") - 30), F.col("start"))
    return spans.where(F.col("label") == label).agg(F.count("*").alias("count"), F.count_if(span.rlike(TITLE_START)).alias("included"), F.count_if(near.rlike(TITLE_BEFORE)).alias("excluded"), F.count_if(span.rlike(REFERENCE_LIKE)).alias("reference_like"))


def region_profile(spans: DataFrame, text: str = "text") -> DataFrame:
    return spans.groupBy("label", region(F.col(text), F.col("start"), F.col("end")).alias("region")).agg(F.count("*").alias("n"))


def cross_labels(spans: DataFrame, value: str = "value") -> DataFrame:
    """(value, labels, total, minority): values under more than one label, and assignments beyond the most frequent."""
    counts = spans.groupBy(value, "label").agg(F.count("*").alias("n"))
    return counts.groupBy(value).agg(F.count("*").alias("labels"), F.sum("n").alias("total"), (F.sum("n") - F.max("n")).alias("minority")).where("labels > 1")


def unlabelled_repeats(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """(doc_id, value, start, overlapping): occurrences of a document's labelled values at unlabelled places.

    ``docs``: doc_id, text, spans (array of start, end, label). Occurrences of one value do not overlap.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, t, own in zip(b["doc_id"], b[text], b[spans], strict=True):
                bounds = {(s["start"], s["end"]) for s in own}
                starts, ends = (sorted(x) for x in zip(*bounds, strict=True)) if bounds else ([], [])
                for v in sorted({t[a:e] for a, e in bounds}):
                    at = t.find(v) if v else -1
                    while at >= 0:
                        if (at, at + len(v)) not in bounds:
                            # spans that begin before its end, less those that end before it
                            out.append((doc, v, at, bisect_left(starts, at + len(v)) > bisect_right(ends, at)))
                        at = t.find(v, at + len(v))
            yield pd.DataFrame(out, columns=["doc_id", "value", "start", "overlapping"])

    return docs.select("doc_id", text, spans).mapInPandas(run, "doc_id long, value string, start int, overlapping boolean")


def adjust_titles(text: str, spans: list[tuple[int, int, str]], policy: str, label: str = "NAME") -> list[tuple[int, int, str]]:
    """Names with the title before them taken in ("included") or at their start left out ("excluded")."""
    import re

    title = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mx)\.?[ \t\r\n]+"
    before, start = re.compile(rf"(?i){title}$"), re.compile(rf"(?i)^{title}")
    out = []
    for a, b, x in spans:
        m = None
        if x == label and policy == "included" and (m := before.search(text[:a])):
            a = m.start()
        elif x == label and policy == "excluded" and (m := start.match(text[a:b])):
            a += m.end()
        if a >= b:
            raise ValueError("nothing is left of a name")
        out.append((a, b, x))
    out.sort()
    if any(x[1] > y[0] for x, y in zip(out, out[1:], strict=False)):
        raise ValueError("spans overlap after the change")
    return out
