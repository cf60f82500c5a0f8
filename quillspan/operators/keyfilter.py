"""A filter on keys of fixed size, so that rows without a match are not shuffled to find that out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspan.sources.scratch import materialize

#: Bits of a key filter. It has at most a 64th as many rows, whatever the number of keys.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, *names: str) -> DataFrame:
    """(word, bits): a bitmap of fixed size of the hashes of ``keys``, to tell rows that surely have none of them."""
    at = F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS))
    one = keys.select(F.floor(at / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    return materialize(one.groupBy("word").agg(F.bit_or("bit").alias("bits")), "key-filter")


def split(rows: DataFrame, bitmap: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have one of the filter's keys, and those that surely have none. Neither is shuffled."""
    at = F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS))
    has = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    held = F.broadcast(bitmap.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    on = (F.floor(at / 64).cast("long") == F.col("_word")) & (F.col("_bits").bitwiseAND(has) != 0)
    return rows.join(held, on, "left_semi"), rows.join(held, on, "left_anti")
