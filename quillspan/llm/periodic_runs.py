"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Level k names each stretch of 2^k words: equal stretches have equal names, so the names of level k + 1 are those of
pairs of names 2^k apart. The longest common extension of two places, forward or backward, is read off the names from
the highest level down, each level giving at most one more stretch. A run of period q and at least four periods holds
a stretch of 3q places whose word equals the one q later; so of places on a grid one is sure to be followed by 2^k equal
words, where 2^k is the greatest power not above q. Those places are the candidates: some n/2q for each q, tried on the
names of level k all at once, and only those that agree are extended to both ends. No text is hashed and no suffix
sorted.

A stretch is reported once, with its smallest period: as runs have four periods or more, a smaller period of the same
stretch divides the larger one, is found too, and has the same borders.

Defined results: a null text has no words; an empty or one-word text has no runs; texts are judged whole, whatever
their length (names take 4 bytes a word and level, candidates are tried ``BLOCK`` at once); repeated rows each give a
row; an empty table gives an empty one; extra columns pass through ``detect`` (one named like a new column makes the
new one take underscores), and are ignored by ``report``; a null id is a row like any other (``report`` leaves its
words as they are).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A run has this many words and periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Candidates tried at once, and rows whose results are held at once.
BLOCK, ROWS = 1 << 20, 128

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_DDL = "struct<start:long,length:long,period:long>"


def names(codes: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, ... words, up to the last level on which two stretches are equal."""
    levels, width = [codes], 1
    while 2 * width <= len(codes):
        last = levels[-1].astype(np.int64)
        kinds, name = np.unique(last[:-width] * (last.max() + 1) + last[width:], return_inverse=True)
        if len(kinds) == len(name):
            break
        levels.append(name.astype(np.int32))
        width *= 2
    return levels


def extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, backward: bool = False) -> np.ndarray:
    """How many words from places i and j on (backward: before them) are equal, pair by pair."""
    i, j = (i.copy(), j.copy())
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, width = levels[k], 1 << k
        at, other = (i - length - width, j - length - width) if backward else (i + length, j + length)
        inside = (at >= 0) & (other < len(name))
        same = inside & (name[np.where(inside, at, 0)] == name[np.where(inside, other, 0)])
        length[same] += width
    return length


def _grid(n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) candidates for the periods from 2^k to below 2^(k+1), some ``BLOCK`` at once."""
    q = np.arange(1 << k, min(1 << (k + 1), n // LEAST_PERIODS + 1), dtype=np.int64)
    step = np.maximum(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) - (1 << k) + 1
    count = np.maximum(0, (n - q - (1 << k)) // step + 1)
    for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(count) // BLOCK)) + 1):
        many = count[part]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield nth * np.repeat(step[part], many), np.repeat(q[part], many)


def find_runs(codes: np.ndarray) -> np.ndarray:
    """Rows (start, length, smallest period) of all maximal runs of a sequence of codes, by start, then period."""
    levels, found = names(codes), [np.empty((0, 3), np.int64)]
    for k, name in enumerate(levels):
        for place, q in _grid(len(codes), k):
            hit = name[place] == name[place + q]
            place, q = place[hit], q[hit]
            if len(place):
                back = extend(levels, place, place + q, backward=True)
                length = q + back + extend(levels, place, place + q)
                long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
                found.append(np.unique(np.stack([place - back, length, q], axis=1)[long], axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    smallest = np.ones(len(every), bool)
    smallest[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[smallest]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest exact length over period; of equal ones that with the smallest start, then period."""
    if not len(runs):
        return None
    ratio = runs[:, 1] / runs[:, 2]
    close = runs[ratio >= ratio.max() * (1 - 1e-12)].tolist()
    return tuple(min(close, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def detect(docs: DataFrame, text: str = "text", rewrite: Callable[[dict, int], np.ndarray | None] | None = None) -> DataFrame:
    """``docs`` with the columns runs (all of them, by start, then period), strongest (null without runs) and collapsed
    (the text's words, without those that ``repeated`` names, joined by one space).

    ``rewrite`` may turn a row's other columns and number of words into the places of the words to be read instead."""
    rows = docs.withColumn(text, F.col(text).cast("string"))
    new = ["runs", "strongest", "collapsed"]
    for x in range(len(new)):
        while new[x] in rows.columns:
            new[x] += "_"

    def one(value: str | None, other: dict) -> tuple:
        words = (value or "").encode().split()
        order = rewrite(other, len(words)) if rewrite and words else None
        if order is not None:
            words = [words[i] for i in order.tolist()]
        known: dict[bytes, int] = {}
        runs = find_runs(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        gone = repeated(runs, len(words))
        return runs, strongest(runs), " ".join(w.decode() for w, x in zip(words, gone.tolist(), strict=True) if not x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others = [c for c in b.schema.names if c != text] if rewrite else []
            for at in range(0, b.num_rows, ROWS):
                piece = b.slice(at, ROWS)
                values = piece.select(others).to_pylist() if others else [{}] * piece.num_rows
                made = [one(x.as_py(), other) for x, other in zip(piece.column(text), values, strict=True)]
                flat = np.concatenate([m[0] for m in made])
                ends = pa.array(np.cumsum([0, *(len(m[0]) for m in made)], dtype=np.int32))
                listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN)))
                best = pa.array([m[1] and dict(zip(("start", "length", "period"), m[1], strict=True)) for m in made], RUN)
                yield pa.RecordBatch.from_arrays([*piece.columns, listed, best, pa.array([m[2] for m in made], pa.string())], [*b.schema.names, *new])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{new[0]}` array<{RUN_DDL}>, `{new[1]}` {RUN_DDL}, `{new[2]}` string")


def planted(row: dict, n: int) -> np.ndarray | None:
    """Of a tenth of the ids: the places that make the words from place a on a repetition of the first p of them."""
    if row["doc_id"] is None or (h := zlib.crc32(str(row["doc_id"]).encode())) % 10:
        return None
    g, i = h // 10, np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def _listed(runs: Column) -> Column:
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rewrite: Callable[[dict, int], np.ndarray | None] | None = planted) -> DataFrame:
    """Each document's number of runs, its strongest run, and digests of its runs and of its collapsed text."""
    found = detect(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), rewrite=rewrite)
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(_listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
