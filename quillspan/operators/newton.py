"""Logistic probes by Newton steps, many groups at once.

A step needs the loss, its slope and its curvature X'WX at a point: sums of column expressions over the rows, one
aggregation for all groups, without Python. They are few numbers a group (groups are labels, folds and the like), so the
driver solves each group's small system and halves steps that do not pay. Features are standardised by the group's own
training rows. A group without both classes has no probe, and its rows no score.

Rows with a null in a feature, label or weight take no part in the fit and get no score; a weight of 0 counts for the
standardisation only; constant features stay at weight 0 by the charge on squared weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quillspan.sources.scratch import materialize

#: The charge on squared weights (not the intercept), the slope at which a probe is done, most steps and halvings.
STRENGTH, DONE, STEPS, HALVINGS, FLAT = 0.001, 1e-8, 100, 40, 1e-12
#: Largest absolute score before it is made a probability.
CLIP = 35.0


@dataclass
class Probe:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray  #: intercept, then weights of standardised features
    loss: float = np.inf
    steepness: float = np.inf
    steps: int = 0
    weight: float = 0.0
    done: bool = False


def _dot(beta: Column, columns: list[Column]) -> Column:
    return sum((F.get(beta, i + 1) * c for i, c in enumerate(columns)), F.get(beta, 0))


def _standardised(features: list[str]) -> list[Column]:
    return [(F.col(f"`{c}`") - F.get("_mean", i)) / F.get("_scale", i) for i, c in enumerate(features)]


def _table(df: DataFrame, probes: dict[tuple, Probe], by: list[str], values: dict[tuple, np.ndarray]) -> DataFrame:
    """The probes as rows to join, at the given coefficients."""
    spark = df.sparkSession
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    rows = [(*k, p.mean.tolist(), p.scale.tolist(), values[k].tolist()) for k, p in probes.items() if k in values]
    return spark.createDataFrame(rows, f"{kinds}, _mean array<double>, _scale array<double>, _beta array<double>")


def fit(train: DataFrame, features: list[str], label: str = "y", weight: str | None = None, by: list[str] | None = None, strength: float = STRENGTH) -> dict[tuple, Probe]:
    """A probe for each group of ``by`` that holds both classes."""
    if not by:
        return {(): p for p in fit(train.withColumn("_all", F.lit(1)), features, label, weight, ["_all"], strength).values()}
    d = len(features)
    rows = train.select(*[F.col(f"`{c}`") for c in [*by, *features]], F.col(label).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")).dropna(subset=[*features, "_y", "_w"])
    rows = materialize(rows, "probe-rows")  # read once a step
    moments = [f for i, c in enumerate(features) for f in (F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}"))]
    seen = rows.groupBy(*by).agg(*moments, F.sum("_w").alias("w"), F.min("_y").alias("low"), F.max("_y").alias("high"), F.min("_w").alias("least"), F.count_if(~F.col("_y").isin(0.0, 1.0)).alias("odd"))
    probes = {}
    for r in seen.collect():
        if r["least"] is not None and r["least"] < 0:
            raise ValueError("a weight is below 0")
        if r["odd"]:
            raise ValueError("a label is neither 0 nor 1")
        if r["w"] and r["low"] != r["high"]:
            scale = np.array([r[f"s{i}"] for i in range(d)])
            probes[tuple(r[c] for c in by)] = Probe(np.array([r[f"m{i}"] for i in range(d)]), np.where(scale < FLAT, 1.0, scale), np.zeros(d + 1), weight=float(r["w"]))
    charge = np.array([0.0, *[strength] * d])

    def sums(values: dict[tuple, np.ndarray]) -> dict[tuple, tuple[float, np.ndarray, np.ndarray]]:
        """Loss, slope and curvature of each group at its coefficients."""
        x = [F.lit(1.0), *(F.col(f"_x{i}") for i in range(d))]
        held = rows.join(F.broadcast(_table(rows, probes, by, values)), by)
        held = held.select(*by, "_y", "_w", _dot(F.col("_beta"), _standardised(features)).alias("_z"), *[c.alias(f"_x{i}") for i, c in enumerate(_standardised(features))])
        p = 1 / (1 + F.exp(-F.col("_z")))
        # log(1 + e^z), without overflow
        soft = F.greatest(F.col("_z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z")))
        held = held.select("*", (F.col("_w") * (p - F.col("_y"))).alias("_r"), (F.col("_w") * p * (1 - p)).alias("_c"), (F.col("_w") * (soft - F.col("_y") * F.col("_z"))).alias("_l"))
        slopes = [F.sum(F.col("_r") * c).alias(f"g{i}") for i, c in enumerate(x)]
        curves = [F.sum(F.col("_c") * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i + 1)]
        out = {}
        for r in held.groupBy(*by).agg(F.sum("_l").alias("l"), *slopes, *curves).collect():
            key = tuple(r[c] for c in by)
            beta, total = values[key], probes[key].weight
            h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) / total + np.diag(charge)
            out[key] = (r["l"] / total + 0.5 * float(charge @ beta**2), np.array([r[f"g{i}"] for i in range(d + 1)]) / total + charge * beta, h)
        return out

    def step(k: tuple) -> np.ndarray:
        try:
            return np.linalg.solve(at[k][2], at[k][1])
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(at[k][2], at[k][1], rcond=FLAT)[0]

    at = sums({k: p.beta for k, p in probes.items()}) if probes else {}
    rate = dict.fromkeys(probes, 1.0)
    for _ in range(STEPS + HALVINGS):
        tried = {}
        for k, p in probes.items():
            p.loss, p.steepness = at[k][0], float(np.abs(at[k][1]).max())
            p.done = p.done or p.steepness <= DONE or p.steps >= STEPS or rate[k] < 0.5**HALVINGS
            if not p.done:
                tried[k] = p.beta - rate[k] * step(k)
        if not tried:
            break
        for k, got in sums(tried).items():
            promised = float(at[k][1] @ step(k))
            if got[0] <= at[k][0] - 1e-4 * rate[k] * promised or (promised < 1e-12 and got[0] <= at[k][0] + 1e-14):
                probes[k].beta, at[k], rate[k] = tried[k], got, 1.0
                probes[k].steps += 1
            else:
                rate[k] /= 2
    return probes


def score(df: DataFrame, probes: dict[tuple, Probe], features: list[str], by: list[str] | None = None, name: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 by its group's probe (null without one)."""
    if not by:
        return score(df.withColumn("_all", F.lit(1)), {(1,): p for p in probes.values()}, features, ["_all"], name).drop("_all")
    table = _table(df, probes, by, {k: p.beta for k, p in probes.items()})
    z = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), _dot(F.col("_beta"), _standardised(features))))
    known = F.lit(True)
    for c in features:
        known &= F.col(f"`{c}`").isNotNull()
    return df.join(F.broadcast(table), by, "left").withColumn(name, F.when(known & F.col("_beta").isNotNull(), 1 / (1 + F.exp(-z)))).drop("_mean", "_scale", "_beta")


def out_of_fold(df: DataFrame, fold: str, folds: int, features: list[str], label: str = "y", weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` with each row's score by the probe of its group that was fitted on the other folds; all are fitted together."""
    by = by or []
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))
    probes = fit(df.withColumn("_fold", F.explode(others)), features, label, weight, [*by, "_fold"])
    return score(df.withColumn("_fold", F.col(fold).cast("int")), probes, features, [*by, "_fold"]).drop("_fold")
