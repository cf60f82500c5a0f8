"""Exact dedup as a tree of merges of sorted digest runs.

Each partition of the input is a leaf: its rows, sorted by digest and merged, are a run with one line for each text,
which holds the row to keep and the number of rows. In each round the runs of ``FAN_IN`` neighbouring nodes are merged
into one, so after r rounds a node speaks for FAN_IN^r leaves, and after the last one for the whole table. A node's run
is dealt over tasks by digest, so no task holds a run as a whole, and a text has at most ``FAN_IN`` lines to be merged at
any node, however many copies it has. (Spark sorts the lines of a task and merges equal ones in one pass: the least
row is a structure, which is aggregated by sorting.)

Lines are merged only where the digest, the length of the text compared and a second, independent hash of it all agree;
all three are part of the key at every level. The answers then go down the same tree, from a node to its ``FAN_IN``
children, and at last from a leaf to its rows, so that no group of copies meets in one task on the way back either.

Defined results: texts are equal if they are so after all white space is deleted; a null text is the empty one; of equal
texts the row with the most code points stays, then that with the smallest id (null only if there is no other), and of
rows that repeat each other one; an empty table gives an empty one; extra columns pass through ``dedup`` and are ignored
by ``groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.llm.common import SPACES, bind
from quillspan.operators.keyfilter import key_filter, split
from quillspan.sources.scratch import materialize

#: Runs merged into one in a round, as a power of 2.
BITS = 4
FAN_IN = 1 << BITS
#: What must agree for two texts to be equal.
KEY = ["digest", "n_left", "second"]
_LEAF = 33


def _key(text: Column) -> Column:
    """digest, n_left, second of a text without white space, and the code points of the text itself."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    of = lambda t: F.struct(F.sha2(t.cast("binary"), 256).alias("digest"), F.length(t).alias("n_left"), F.xxhash64(t).alias("second"))
    return F.struct(bind(F.regexp_replace(whole, SPACES, ""), of).alias("key"), F.length(whole).alias("n_chars"))


def _rank(n_chars: str, doc_id: str) -> list[Column]:
    """The order in which rows stay, least first."""
    return [(-F.col(n_chars)).alias("less"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id")]


def rows_with_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, digest, n_left, second, n_chars), written once: a row's number is its leaf's and its place there."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), _key(F.col(text)).alias("k"))
    return materialize(keyed.select("doc_id", "row", "k.key.*", "k.n_chars"), "digests")


def merge_tree(rows: DataFrame) -> list[DataFrame]:
    """The runs (node, key, best, n) of every level, leaves first, the whole table's last; each is written."""
    line = rows.select(F.shiftrightunsigned("row", _LEAF).alias("node"), *KEY, F.struct(*_rank("n_chars", "doc_id"), F.col("row")).alias("best"), F.lit(1).cast("long").alias("n"))
    merged = lambda lines: lines.groupBy("node", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    levels = [materialize(merged(line), "run-0")]
    last = rows.agg(F.max(F.shiftrightunsigned("row", _LEAF))).first()[0] or 0
    while last:
        last >>= BITS
        levels.append(materialize(merged(levels[-1].withColumn("node", F.shiftright("node", BITS))), f"run-{len(levels)}"))
    return levels


def _down(levels: list[DataFrame]) -> DataFrame:
    """(leaf, key, best, n) of every text that stands in more than one row, taken down the tree level by level."""
    told = levels[-1].where("n > 1")
    for run in levels[-2::-1]:
        told = run.select("node", *KEY, F.shiftright("node", BITS).alias("up")).join(told.withColumnRenamed("node", "up"), ["up", *KEY]).drop("up")
    return told.withColumnRenamed("node", "leaf")


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: of each row, which row of its group stays, and whether it is the one."""
    rows = rows_with_keys(docs, text, doc_id)
    told = _down(merge_tree(rows))
    met = rows.withColumn("leaf", F.shiftrightunsigned("row", _LEAF)).join(told, ["leaf", *KEY], "left")
    alone = F.col("n").isNull()
    return met.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only texts that may have a copy are shuffled."""
    best = merge_tree(rows_with_keys(docs, text, doc_id))[-1].where("n > 1").select(*KEY, (-F.col("best.less")).alias("n_chars"), F.col("best.doc_id").alias("doc_id"))
    told = materialize(best, "stays")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(doc_id).alias("doc_id"), _key(F.col(text)).alias("k")).select("all", "doc_id", "k.key.*", "k.n_chars")
    maybe, alone = split(tagged, key_filter(told, *KEY), *KEY)
    told = told.select(*[F.col(c).alias(f"_{c}") for c in told.columns])
    same = lambda *names: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    only = maybe.join(told, same(*KEY), "left_anti")
    stays = maybe.join(told, same(*KEY, "n_chars", "doc_id"), "left_semi").dropDuplicates([*KEY, "n_chars", "doc_id"])
    return alone.unionByName(only).unionByName(stays).select("all.*")
