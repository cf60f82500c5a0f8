"""Integrity audits: coverage, uniqueness, contiguity, overlaps, orphans, and rows that report checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, keys): keys on the left or right only, and on both; a full outer join of distinct keys."""
    a = left.select(F.col(key).alias("a")).distinct()
    b = right.select(F.col(key).alias("b")).distinct()
    side = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("both")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("keys"))


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose key no owner has."""
    return rows.join(owners.select(key), key, "left_anti")


def with_counts(docs: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` with the number of their rows, 0 if there are none."""
    counts = rows.groupBy(key).agg(F.count("*").alias(name))
    return docs.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, by multiplicity, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return symmetric_difference(a, b).isEmpty()


def duplicates(rows: DataFrame, key: Column | str, ident: str, conflict: str | None = None) -> DataFrame:
    """(key, members, smallest, excess, conflict): keys that more than one row has."""
    key = F.col(key) if isinstance(key, str) else key
    extra = F.count_distinct(conflict) > 1 if conflict else F.lit(False)
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("members"), F.min(ident).alias("smallest"), extra.alias("conflict")).where("members > 1").withColumn("excess", F.col("members") - 1)


def contiguity(rows: DataFrame, key: str, index: str, base: int = 0) -> DataFrame:
    """(key, n, contiguous): whether the indices run from ``base`` without gap or repeat."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("kinds"))
    return g.select(key, "n", ((F.col("low") == base) & (F.col("high") == F.col("n") - 1 + base) & (F.col("kinds") == F.col("n"))).alias("contiguous"))


def overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans with ``over_previous`` (starts before the last one ends) and ``over_any`` (before the furthest end so far)."""
    w = Window.partitionBy(key).orderBy("start", "end", "label")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumns({"over_previous": F.coalesce(F.col("start") < F.lag("end").over(w), F.lit(False)), "over_any": F.coalesce(F.col("start") < F.max("end").over(before), F.lit(False))})


def numbered(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans with ``slot``: their place in order, from 1."""
    return spans.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "label")))


def invalid_entities(entities: DataFrame, labels: tuple[str, ...], text: str = "full_text") -> DataFrame:
    """(reason, n): entities with an unknown label, bounds outside the text, or a text unlike their slice."""
    bounds = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length(text))
    slice_ = F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))
    reason = F.when(~F.col("label").isin(*labels), "label").when(~bounds, "bounds").when(slice_ != F.col("text"), "text")
    return entities.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_first, only_second, both, subset, equal) of two columns of keys, as sets."""
    side = lambda df, n: df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(n, F.lit(1))
    met = side(a, "_a").join(side(b, "_b"), key, "full_outer")
    only = met.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))
    return only.withColumns({"subset": F.col("only_first") == 0, "equal": (F.col("only_first") == 0) & (F.col("only_second") == 0)})


def shared_partitions(rows: DataFrame, pools: DataFrame, key: str, name: str, into: str = "overlap_partitions") -> DataFrame:
    """``rows`` with the sorted names of the pools that hold their key."""
    found = pools.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias(into))
    return rows.join(found, key, "left").withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def check(name: str, df: DataFrame, failed: Column, ident: str, examples: int = 8) -> DataFrame:
    """One row: name, failures, denominator, status, and the smallest identifiers that failed."""
    few = df.where(failed).select(F.col(ident).cast("string").alias("i")).distinct().orderBy("i").limit(examples).agg(F.array_sort(F.collect_list("i")).alias("examples")).withColumn("name", F.lit(name))
    out = df.agg(F.count_if(failed).alias("failures"), F.count("*").alias("denominator")).withColumn("name", F.lit(name)).join(few, "name")
    return out.select("name", "failures", "denominator", F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"), "examples")


def name_sniff(columns: list[str], pattern: str = r"label|target|entity|pii|annotation") -> list[str]:
    """Column names that look like answers."""
    import re

    return [c for c in columns if re.search(pattern, c, re.I)]
