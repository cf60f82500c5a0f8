"""Mixing sources to target weights by Pareto order sampling, in built-in expressions only.

Each source gets a share of the mix by weight, at most ``cap`` times its own size; what is above is
shared again by weight. A source's ratio of target to size gives every one of its documents the whole
copies in the ratio for certain. One more copy goes to an unequal-probability sample: a document of n words is
included with probability p = min(1, level * n ** 0.5), the level such that the expected words are those left to
take. Documents are ranked by random odds over inclusion odds, u / (1 - u) / (p / (1 - p)), and taken in that
order up to a fixed size, which is a number of words, as the targets are: the document at the border goes in
if that comes nearer. Of those not taken, the one whose size comes nearest to what is still open closes the gap.
Random numbers come from a hash of id and text, so reruns agree.

Sizes and hashes are written once and all is planned on them. Order within a source comes from bins of the rank:
bin totals are summed on the map side, only the bin at the border is sorted, so a source that holds a third
of all rows is never gathered. Levels come from the table of distinct sizes.

Defined results: a null text has size 0; null sources are one source, last in order; documents of size 0
take 0 words; an empty table, or one without words, has target 0; rows that repeat a document (id and text) share
its rank and are taken one by one, in order of their files; a null id is an id like any other; extra
columns are ignored (or kept, by ``mix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan.llm.common import words
from quillspan.sources.scratch import materialize

WEIGHTS = (5, 2, 1)
TOTAL, CAP = 1.5, 2.0
BINS = 4096
#: Per-source rows are broadcast up to this many sources.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """From (source, source_size): source, source_size, target. One row per source throughout.

    With sources in order of cap over weight, those up to some place are at their cap, and the level of the
    others is (total - caps so far) / (weights left); the first level under its own cap is the answer.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.get(cycle, (F.row_number().over(order) - 1) % len(weights))).withColumn("cap", cap * F.col("source_size"))
    ranked = ranked.withColumn("r", F.col("cap") / F.col("w"))
    up = Window.orderBy("r", F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (total * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("r"))
    levels = levels.withColumn("water", F.min(F.when(F.col("open"), F.struct("r", "level"))).over(everything)["level"])
    return levels.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("water"))).alias("target"))


def _uniform(doc_id: Column, digest: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of the MD5 of the id and the text's digest."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def _sized(docs: DataFrame, text: str, source: str, doc_id: str, extra: list[str]) -> DataFrame:
    """_doc, _source, _size, _h (digest of the text), _u of every row. ``extra`` columns come along."""
    size = F.size(words(F.col(text).cast("string"))).cast("long")
    base = docs.select(F.col(doc_id).alias("_doc"), F.col(source).cast("string").alias("_source"), size.alias("_size"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("_h"), *[F.col(f"`{c}`").alias(f"x_{i}") for i, c in enumerate(extra)])
    return base.withColumn("_u", _uniform(F.col("_doc"), F.col("_h")))


def _with(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source in ``goal``."""
    return rows.join(goal, F.col("_source").eqNullSafe(F.col("source"))).drop("source")


def _ranked(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` with their source's ``goal``, _v (the Pareto rank q as q / (1 + q)) and _bin; -1: certain."""
    p, u = F.least(F.lit(1.0), F.col("level") * F.sqrt("_size")), F.col("_u")
    v = F.when(p >= 1, 0.0).when(p <= 0, 1.0).otherwise(u * (1 - p) / (u * (1 - p) + (1 - u) * p))
    ranked = _with(rows, goal).withColumn("_v", v)
    return ranked.withColumn("_bin", F.when(F.col("_v") == 0, -1).otherwise(F.least(F.lit(BINS - 1), F.floor(F.col("_v") * BINS))).cast("int"))


def _levels(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with level: inclusion probabilities are min(1, level * size ** 0.5). ``sizes``: _source, _size, n.

    With the largest sizes certain, the level of the others follows from the words left; the first level that
    makes none of the others certain is the answer."""
    down = Window.partitionBy("_source").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("_source").orderBy("_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    certain = F.coalesce(F.sum(F.col("n") * F.col("_size")).over(down), F.lit(0))
    others = F.sum(F.col("n") * F.col("_size") * F.sqrt("_size")).over(up)
    each = _with(sizes.where("_size > 0"), goal.select("source", "rest")).withColumn("level", (F.col("rest") - certain) / others)
    level = each.where(F.col("level") * F.sqrt("_size") <= 1).groupBy("_source").agg(F.max(F.struct("_size", "level"))["level"].alias("level"))
    return goal.join(level, F.col("_source").eqNullSafe(F.col("source")), "left").drop("_source").withColumn("level", F.coalesce("level", F.lit(0.0)))


_KEY = ("_source", "_doc", "_h")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with _n: their number among rows of the same key, counted file by file, so no key is gathered."""
    own = materialize(rows.withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "mix-repeats")
    before = Window.partitionBy(*_KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy(*_KEY, "_part").agg(F.count("*").alias("c")).withColumn("c", F.coalesce(F.sum("c").over(before), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"s{c}") for c in _KEY], F.col("_part").alias("s_part"), "c")
    same = F.col("_part") == F.col("s_part")
    for c in _KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"s{c}"))
    inside = Window.partitionBy(*_KEY, "_part").orderBy("_i")
    return own.join(starts, same).withColumn("_n", F.col("c") + F.row_number().over(inside)).drop("c", "s_part", *[f"s{c}" for c in _KEY], "_part", "_i")


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP, extra: list[str] | None = None) -> DataFrame:
    """_doc, _source, _size, source_size, target, copies for every document (and ``extra`` as x_0, x_1, ...)."""
    light = materialize(_sized(docs, text, source, doc_id, []), "mix-sizes")
    sizes = materialize(light.groupBy("_source", "_size").agg(F.count("*").alias("n")), "mix-counts")
    goal = targets(sizes.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("n") * F.col("_size")).alias("source_size")), weights, total, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = materialize(_levels(sizes, goal), "mix-levels")
    few = goal.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda x: x)
    # the bin where the running words of the source pass what is left to take
    bins = materialize(_ranked(light, hint(goal)).groupBy("_source", "_bin").agg(F.sum("_size").alias("n")), "mix-bins")
    run = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    border = _with(bins.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))), goal).where("_bin >= 0 and before < rest and before + n >= rest")
    border = border.groupBy("_source").agg(F.min(F.struct("_bin", "before")).alias("b"))
    goal = goal.join(border, F.col("_source").eqNullSafe(F.col("source")), "left").drop("_source")
    goal = materialize(goal.withColumns({"border": F.coalesce("b._bin", F.lit(-2)), "before": F.coalesce("b.before", F.lit(0)).cast("long")}).drop("b"), "mix-border")
    # in the border's bin, rows of one document share a place; k of its n rows are taken
    ranked = _ranked(light, hint(goal))
    here = ranked.where("_bin = border and _size > 0").groupBy(*_KEY, "_size", "_u", "_v", "before", "rest").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("_source").orderBy("_v", "_u", "_size", "_h", "_doc").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("_size")).over(inside), F.lit(0))
    here = here.withColumn("k", F.greatest(F.lit(0), F.least("n", F.floor((F.col("rest") - start) / F.col("_size") + 0.5))).cast("long"))
    here = materialize(here.select(*_KEY, "n", "k", (F.col("k") * F.col("_size")).alias("words")), "mix-here")
    words_here = here.groupBy("_source").agg(F.sum("words").alias("words"))
    goal = goal.join(words_here, F.col("_source").eqNullSafe(F.col("source")), "left").drop("_source").withColumn("gap", F.when(F.col("border") >= 0, F.col("rest") - F.col("before") - F.coalesce("words", F.lit(0))).otherwise(0.0)).drop("words")
    goal = materialize(goal, "mix-gap")
    # what closes the gap, of the rows not taken
    k = here.select(*[F.col(c).alias(f"h{c}") for c in _KEY], "n", "k")
    later = _ranked(light, hint(goal)).where("_bin >= border and _size > 0 and gap > 0")
    same = F.col("_bin") == F.col("border")
    for c in _KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"h{c}"))
    nearest = F.struct(F.abs(F.col("gap") - F.col("_size")).alias("d"), "_v", "_u", "_size", "_h", "_doc")
    after = later.where("_bin > border").select("_source", "gap", nearest.alias("x"))
    beside = later.where("_bin = border").join(k, same).where("k < n").select("_source", "gap", nearest.alias("x"))
    last = after.unionByName(beside).where("x.d < gap").groupBy("_source").agg(F.min("x").alias("x"))
    goal = goal.join(last, F.col("_source").eqNullSafe(F.col("source")), "left").drop("_source")
    goal = materialize(goal.select("source", "source_size", "target", "whole", "level", "border", F.col("x").isNotNull().alias("closed"), F.col("x._doc").alias("last_doc"), F.col("x._h").alias("last_h")), "mix-goal")
    full = light if extra is None else _sized(docs, text, source, doc_id, extra)
    full = _ranked(full, hint(goal)).withColumn("_last", F.col("closed") & F.col("_doc").eqNullSafe(F.col("last_doc")) & (F.col("_h") == F.col("last_h")))
    apart = (F.col("_size") > 0) & ((F.col("_bin") == F.col("border")) | F.col("_last"))
    one_by_one = _numbered(full.where(apart)).join(k, same, "left")
    one_by_one = one_by_one.withColumn("_more", (F.col("_n") <= F.coalesce("k", F.lit(0)) + F.col("_last").cast("int")).cast("long"))
    others = full.where(~apart).withColumn("_more", (F.col("_bin") < F.col("border")).cast("long"))
    cols = ["_doc", "_source", "_size", "source_size", "target", "whole", "_more", *[f"x_{i}" for i in range(len(extra or []))]]
    both = others.select(*cols).unionByName(one_by_one.select(*cols))
    return both.withColumn("copies", F.when(F.col("_size") > 0, F.least(F.col("whole") + F.col("_more"), F.lit(int(cap)))).otherwise(0)).drop("whole", "_more")


def taken(docs: DataFrame, **names) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies of every document."""
    p = plan(docs, **names)
    return p.select(F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("_size")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame, **names) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as many times as it is taken."""
    p = plan(docs, extra=docs.columns, **names)
    return p.where("copies > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"x_{i}").alias(c) for i, c in enumerate(docs.columns)])
