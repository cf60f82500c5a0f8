"""Batches of like length under a budget of cells, and the best few rows of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan.operators.prefix import running_total

#: Parts into which the rows of a key are dealt before its best are chosen.
SALTS = 64


def length_class(length: Column) -> Column:
    """A length's leading four binary digits, the rest 0: lengths of a class differ by less than an eighth."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.length(F.bin(length)) - 4)).cast("long")
    return length - length % step


def length_batches(df: DataFrame, length: str, ident: str, budget: int) -> DataFrame:
    """``df`` with the column batch: in each, rows times greatest length is at most ``budget`` (or it is one row).

    Batches are cut inside classes of length, in order of length and id. Places come from running totals over ranges, and
    what is known of a class is a row each (a few hundred at most), so no task sees a class as a whole. Rows of length 0
    or null get no batch (null)."""
    spare = F.coalesce(F.col(length), F.lit(0)) <= 0
    used = df.where(~spare).withColumns({"_class": length_class(F.col(length).cast("long")), "_one": F.lit(1).cast("long")})
    placed = running_total(used, ["_class", length, ident], {"_before": "_one"})
    classes = used.groupBy("_class").agg(F.count("*").alias("_n"), F.max(length).alias("_top")).withColumn("_per", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_top"))).cast("long"))
    ahead = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    known = classes.select("_class", "_per", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rows"), F.coalesce(F.sum(F.ceil(F.col("_n") / F.col("_per"))).over(ahead), F.lit(0)).alias("_batches"))
    out = placed.join(F.broadcast(known), "_class").withColumn("batch", F.col("_batches") + F.floor((F.col("_before") - F.col("_rows")) / F.col("_per")))
    keep = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*keep, F.col("batch").cast("long").alias("batch")).unionByName(df.where(spare).select(*keep, F.lit(None).cast("long").alias("batch")))


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key in the given order, which must tell rows apart; with their rank from 1.

    Spark drops what cannot be among the first before it shuffles (a bounded heap a key and task), and does so twice: by key and
    part of the key first, then by key, so a key never brings more than ``k`` rows a part to one task."""
    part = df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "_part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
