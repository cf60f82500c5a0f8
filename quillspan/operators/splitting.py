"""Deterministic sampling and leak-safe splits that keep groups whole."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan.operators.prefix import running_total
from quillspan.sources.scratch import materialize


def order_hash(seed: int, key: Column, tag: str = "") -> Column:
    """SHA-256 of "seed:key" as hex: an order that looks random and never changes."""
    return F.sha2(F.concat(F.lit(f"{seed}:{tag}"), key.cast("string")), 256)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of least hash."""
    return df.withColumn("_h", order_hash(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def split_conflicts(records: DataFrame, group: str = "duplicate_group") -> DataFrame:
    """Groups whose members are fixed to train and to dev."""
    return records.groupBy(group).agg(F.max((F.col("fixed") == "train")).alias("t"), F.max((F.col("fixed") == "dev")).alias("d")).where("t and d").select(group)


def assign_splits(records: DataFrame, seed: int, group: str = "duplicate_group", ident: str = "document_id", share: float = 0.1, least: int = 10) -> DataFrame:
    """(group, ident, stratum, partition): whole groups to holdout, dev or train, by stratum.

    ``records`` has ident, group, stratum and ``fixed`` (train, dev, reviewed or null). A group goes where a
    member is fixed (train first, then dev; reviewed goes to dev). Free groups of a stratum, in hash order,
    fill holdout to its target, then dev, then train. The stratum is that of the smallest id in the group.
    Only per-group rows enter the ordered step.
    """
    conflict = split_conflicts(records, group)
    if not conflict.isEmpty():
        raise ValueError("a duplicate group crosses the historical split")
    groups = records.groupBy(group).agg(
        F.count("*").alias("size"), F.min_by("stratum", ident).alias("stratum"),
        F.when(F.max(F.col("fixed") == "train"), "train").when(F.max((F.col("fixed") == "dev") | (F.col("fixed") == "reviewed")), "dev").alias("role"),
    )
    groups = materialize(groups.withColumn("h", order_hash(seed, F.col(group))), "split-groups")
    strata = groups.groupBy("stratum").agg(F.sum("size").alias("total"), F.coalesce(F.sum(F.when(F.col("role") == "dev", F.col("size"))), F.lit(0)).alias("dev_fixed"))
    strata = strata.withColumn("target", F.when(F.col("total") >= least, F.greatest(F.lit(1), F.bround(F.col("total") * share).cast("long"))).otherwise(0)).withColumnRenamed("stratum", "s")
    # the running size in a stratum is that over all strata in order, less what its first group has before it
    run = materialize(running_total(groups.where("role is null"), ["stratum", "h", group], {"so_far": "size"}), "split-run")
    first = run.groupBy(F.col("stratum").alias("f")).agg(F.min("so_far").alias("first"))
    of = lambda c: F.col("stratum").eqNullSafe(F.col(c))
    free = run.join(first, of("f")).join(strata, of("s")).withColumn("before", F.col("so_far") - F.col("first"))
    # groups enter holdout while what came before is under the target; dev counts on from where holdout ended
    free = free.withColumn("in_holdout", F.col("before") < F.col("target")).drop("f", "s")
    held = free.where("in_holdout").groupBy(F.col("stratum").alias("t")).agg(F.sum("size").alias("held"))
    free = free.join(held, of("t"), "left").withColumn("held", F.coalesce("held", F.lit(0)))
    free = free.withColumn("partition", F.when(F.col("in_holdout"), "holdout").when(F.col("dev_fixed") + F.col("before") - F.col("held") < F.col("target"), "dev").otherwise("train"))
    placed = free.select(group, "partition").unionByName(groups.where("role is not null").select(group, F.col("role").alias("partition")))
    return records.join(placed, group).select(F.col(group), ident, "stratum", "partition")


def quota_roles(groups: DataFrame, quotas: list[tuple[str, int]], rest: str, seed: int, group: str = "group_id", size: str = "size") -> DataFrame:
    """Whole groups in hash order fill each role until its quota is reached; the others get ``rest``."""
    placed, left = [], groups.withColumn("_h", order_hash(seed, F.col(group)))
    for name, quota in quotas:
        run = running_total(left, ["_h", group], {"_b": size})
        placed.append(run.where(F.col("_b") < quota).drop("_b").withColumn("role", F.lit(name)))
        left = run.where(F.col("_b") >= quota).drop("_b")
    out = left.withColumn("role", F.lit(rest))
    for p in placed:
        out = out.unionByName(p)
    return out.drop("_h")


def family_sample(groups: DataFrame, size: int, seed: int, group: str = "group_id", count: str = "size") -> DataFrame:
    """Whole families in hash order until at least ``size`` members."""
    return running_total(groups.withColumn("_h", order_hash(seed, F.col(group))), ["_h", group], {"_b": count}).where(F.col("_b") < size).drop("_b", "_h")


class _Filling:
    """Families of one size dealt to the least loaded fold, ties to the lower: the q-th goes where the q-th smallest
    of all pairs (load + k * size, fold), k = 0, 1, ..., stands."""

    def __init__(self, loads: np.ndarray, size: int):
        self.loads, self.size = loads, size

    def upto(self, level: int) -> np.ndarray:
        """How many families each fold takes at loads of at most ``level``."""
        return np.maximum(0, (level - self.loads) // self.size + 1)

    def folds(self, low: int, high: int) -> np.ndarray:
        """The folds of families low .. high - 1."""
        a, b = int(self.loads.min()), int(self.loads.max()) + self.size * (high + 1)
        level = lambda q: bisect.bisect_left(range(a, b + 1), q, key=lambda v: int(self.upto(v).sum())) + a
        before, after = self.upto(level(low + 1) - 1), self.upto(level(high))
        keys = [(int(self.loads[f] + k * self.size), f) for f in range(len(self.loads)) for k in range(int(before[f]), int(after[f]))]
        skip = low - int(before.sum())
        return np.array([f for _, f in sorted(keys)[skip : skip + high - low]], dtype=np.int32)

    def after(self, count: int) -> np.ndarray:
        """The loads when ``count`` families are dealt."""
        a, b = int(self.loads.min()), int(self.loads.max()) + self.size * (count + 1)
        level = bisect.bisect_left(range(a, b + 1), count, key=lambda v: int(self.upto(v).sum())) + a
        whole = self.upto(level - 1)
        last = [f for f in range(len(self.loads)) if self.upto(level)[f] > whole[f]][: count - int(whole.sum())]
        whole[last] += 1
        return self.loads + whole * self.size


def greedy_folds(groups: DataFrame, folds: int, seed: int, group: str = "group_id", size: str = "size") -> DataFrame:
    """Families, largest first (ties by hash), each to the fold with the fewest members, ties to the lower fold.

    Where a family goes follows from the loads before its size and its place among families of that size. The loads
    are worked out from the number of families of each size, of which there are at most as many as the root of
    twice the members; the places are running totals over ranges. So no task sees all families.
    """
    kind = groups.schema[group].dataType.simpleString()
    rows = materialize(groups.select(F.col(group).alias("g"), F.col(size).cast("long").alias("n"), order_hash(seed, F.col(group)).alias("h"), F.lit(1).alias("one")), "folds")
    sizes = sorted(((r["n"], r["c"]) for r in rows.groupBy("n").agg(F.count("*").alias("c")).collect()), reverse=True)
    loads, before, first = np.zeros(folds, np.int64), 0, {}
    for n, count in sizes:
        first[n] = (before, loads)
        before += count
        loads = _Filling(loads, n).after(count) if n > 0 else loads
    sent = groups.sparkSession.sparkContext.broadcast(first)
    run = running_total(rows.withColumn("m", -F.col("n")), ["m", "h", "g"], {"place": "one"})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at = b.column("n").to_numpy(), b.column("place").to_numpy()
            out = np.zeros(len(n), np.int32)
            order = np.lexsort((at, -n))
            for rows in np.split(order, np.nonzero(np.diff(n[order]))[0] + 1):
                if not len(rows):
                    continue
                start, loads = sent.value[int(n[rows[0]])]
                if n[rows[0]] <= 0:  # adds nothing: all to the least loaded fold
                    out[rows] = int(loads.argmin())
                    continue
                q = at[rows] - start
                for run in np.split(np.arange(len(q)), np.nonzero(np.diff(q) != 1)[0] + 1):
                    out[rows[run]] = _Filling(loads, int(n[rows[0]])).folds(int(q[run[0]]), int(q[run[-1]]) + 1)
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("n"), pa.array(out)], [group, "size", "fold"])

    return run.select("g", "n", "place").mapInArrow(place, f"`{group}` {kind}, size long, fold int")


def whole_families(members: DataFrame, group: str, eligible: str) -> DataFrame:
    """(group, members): families of which every member is eligible."""
    return members.groupBy(group).agg(F.bool_and(eligible).alias("ok"), F.count("*").alias("members")).where("ok").drop("ok")


def exposure_flags(docs: DataFrame, evidence: dict[str, DataFrame], ident: str) -> DataFrame:
    """``docs`` with the sorted names of the evidence tables that hold their id, and ``exposed``."""
    if not evidence:
        return docs.withColumns({"flags": F.array().cast("array<string>"), "exposed": F.lit(False)})
    parts = [df.select(F.col(ident)).distinct().withColumn("_f", F.lit(n)) for n, df in evidence.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = every.groupBy(ident).agg(F.array_sort(F.collect_set("_f")).alias("flags"))
    out = docs.join(found, ident, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    return out.withColumn("exposed", F.size("flags") > 0)


def capped_negatives(df: DataFrame, key: str, label: str, ident: str, cap: int, seed: int) -> DataFrame:
    """All positives (weight 1) and up to ``cap`` negatives a key in hash order, each weighing n/taken."""
    neg = df.where(~F.col(label))
    order = Window.partitionBy(key).orderBy(order_hash(seed, F.col(ident)), ident)
    some = neg.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(key))}).where(F.col("_r") <= cap)
    some = some.withColumn("weight", F.col("_n") / F.least(F.col("_n"), F.lit(cap))).drop("_r", "_n")
    return df.where(F.col(label)).withColumn("weight", F.lit(1.0)).unionByName(some)


def hard_negatives(df: DataFrame, key: list[str], score: str, positive: str, ident: str, n: int = 4) -> DataFrame:
    """(key, positive id, negative id, both scores): each positive with the n highest-scored negatives of its key."""
    order = Window.partitionBy(*key).orderBy(F.desc(score), ident)
    hard = df.where(~F.col(positive)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select(*key, F.col(ident).alias("negative"), F.col(score).alias("negative_score"))
    good = df.where(F.col(positive)).select(*key, F.col(ident).alias("positive"), F.col(score).alias("positive_score"))
    return good.join(hard, key)


def top_per(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
