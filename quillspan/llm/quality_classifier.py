"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on statistics of labelled training texts; every path from a root becomes a
rule, a conjunction of thresholds; a lasso logistic regression keeps few rules and weighs them; the result
is compiled into one Spark column expression, so scoring is a plain scan.

Only the fit uses a sample: at most ``SAMPLE`` labelled training rows, taken by the order of a hash of the
id, are brought to the driver as statistics (a few dozen bytes a row). Scoring covers every row.

Inputs of a score are statistics of the text alone.

Defined results: a null text scores as an empty one; labels that are null are not learnt from, and labels
repeated for an id each count; without labels of both kinds the score is the share of label 1 seen (0.5
without any); a null id is not held out and never learnt from; repeated rows each give a row; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quillspan.llm.common import WORD, bind, words

SAMPLE = 20_000
HELD_MOD, HELD_AT, THRESHOLD = 5, 0, 0.3
TREES, DEPTH, RATE, BINS, LEAF_ROWS = 30, 3, 0.3, 32, 20
#: Lasso strengths tried; the one of least loss on a fifth of the sample is used.
STRENGTHS = (0.03, 0.01, 0.003, 0.001, 0.0003)

STATS = ("log_chars", "log_words", "mean_word", "upper", "symbols", "marks", "digits", "distinct", "adjacent", "line_words", "distinct_lines", "pauses", "bare")


def statistics(text: Column) -> Column:
    """Struct of the numbers named in ``STATS``."""
    text = F.coalesce(text, F.lit(""))
    only = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def of(w: Column, x: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        some = lambda test: F.size(F.filter(w, test)) / n
        return F.struct(
            F.log1p(F.length(text).cast("double")).alias("log_chars"),
            F.log1p(F.size(w).cast("double")).alias("log_words"),
            (F.aggregate(w, F.lit(0).cast("long"), lambda a, y: a + F.length(y)) / n).alias("mean_word"),
            (only(r"\p{Lu}") / chars).alias("upper"),
            (only(r"#*$%&|<>") / chars).alias("symbols"),
            (only("!?") / chars).alias("marks"),
            (only("0-9") / chars).alias("digits"),
            (F.size(F.array_distinct(w)) / n).alias("distinct"),
            some(lambda y, i: F.coalesce(y == F.get(w, i - 1), F.lit(False))).alias("adjacent"),
            (F.size(w) / F.greatest(F.size(x), F.lit(1))).cast("double").alias("line_words"),
            (F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1))).cast("double").alias("distinct_lines"),
            some(lambda y: F.right(y, F.lit(1)).isin(".", ",", ";", ":")).alias("pauses"),
            some(lambda y: F.length(y) == 1).alias("bare"),
        )

    return bind(words(text), lambda w: bind(lines, lambda x: of(w, x)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold) with its weight in the score."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, [(x[:, j] > t) == above for j, above, t in self.tests])

    def column(self, s: Column) -> Column:
        parts = [(s[STATS[j]] > F.lit(t)) if above else (s[STATS[j]] <= F.lit(t)) for j, above, t in self.tests]
        return F.when(reduce(lambda a, b: a & b, parts), F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as a column expression over a struct of statistics."""
        total = reduce(lambda a, r: a + r, [x.column(stats) for x in self.rules], F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """One tree of depth ``DEPTH`` on gradients: its outputs, and the path of every node but the root."""
    out, paths = np.zeros(len(x)), []

    def grow(rows: np.ndarray, path: tuple, depth: int) -> None:
        if path:
            paths.append(path)
        best = (1e-6, -1, 0.0)
        total, mass = g[rows].sum(), h[rows].sum()
        if depth:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(bins[rows, j], g[rows], len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(bins[rows, j], h[rows], len(c) + 1))[:-1]
                ns = np.cumsum(np.bincount(bins[rows, j], minlength=len(c) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (total - gs) ** 2 / (mass - hs + 1) - total**2 / (mass + 1)
                gain[(ns < LEAF_ROWS) | (len(rows) - ns < LEAF_ROWS)] = -1
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), j, float(c[k])), key=lambda b: b[0])
        if best[1] < 0:
            out[rows] = total / (mass + 1)
            return
        _, j, t = best
        right = x[rows, j] > t
        grow(rows[~right], (*path, (j, False, t)), depth - 1)
        grow(rows[right], (*path, (j, True, t)), depth - 1)

    grow(np.arange(len(x)), (), DEPTH)
    return out, paths


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(a: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1 logistic regression, by accelerated proximal gradient steps."""
    n = len(a)
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / (0.25 * (np.linalg.norm(a @ v) ** 2 + n) / n + 1e-9)
    w, b = np.zeros(a.shape[1]), 0.0
    u, c, t = w, b, 1.0
    for _ in range(rounds):
        r = _sigmoid(a @ u + c) - y
        new = u - step * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * strength, 0)
        bias = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / t2 * (new - w), bias + (t - 1) / t2 * (bias - b)
        w, b, t = new, bias, t2
    return w, b


def fit_rows(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """The ensemble for statistics ``x`` and labels ``y`` (0 or 1)."""
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble(float(np.log(p / (1 - p))), ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z, seen = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = _sigmoid(z)
        out, paths = _tree(x, bins, cuts, y - p, p * (1 - p))
        z = z + RATE * out
        seen.update(dict.fromkeys(paths))
    kept: dict[bytes, tuple] = {}
    for path in seen:
        holds = Rule(path).holds(x)
        if LEAF_ROWS <= holds.sum() <= len(y) - LEAF_ROWS:
            kept.setdefault(np.packbits(holds).tobytes(), path)
    rules = [Rule(p) for p in kept.values()]
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    scale = np.sqrt(a.mean(axis=0) * (1 - a.mean(axis=0)))
    a /= scale
    check = np.arange(len(y)) % 5 == 0

    def loss(strength: float) -> float:
        w, b = _lasso(a[~check], y[~check], strength)
        p = np.clip(_sigmoid(a[check] @ w + b), 1e-9, 1 - 1e-9)
        return float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())

    w, b = _lasso(a, y, min(STRENGTHS, key=loss))
    return Ensemble(float(b), tuple(Rule(r.tests, float(x)) for r, x in zip(rules, w / scale, strict=True) if abs(x) > 1e-9))


def held_out(doc_id: Column, mod: int = HELD_MOD, at: int = HELD_AT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == at, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """Learn from labelled rows that are not held out, at most ``sample`` of them, however often ids are repeated."""
    own = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = own.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    met = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    rows = met.select("_id", "_y", statistics(F.col("_text")).alias("s")).select("_id", "_y", "s.*")
    # rows that repeat an id are more than the labels chosen: the bound holds for what is brought here too
    table = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(sample).toPandas().sort_values(["_id", "_y", *STATS])
    return fit_rows(table[list(STATS)].to_numpy(float).reshape(len(table), len(STATS)), table["_y"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    value = bind(statistics(F.col(text).cast("string")), model.score)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
