"""Score tables as flat columns with offsets: one long list of values for all documents, and where each one's begin and end.

That is how scores are frozen: a value table (pos, columns) and an offset table (doc, ident, low, high), both plain
tables, so they are written, published and hashed like any other. Documents are numbered in the order of their ids.
Positions come from running totals over ranges; values find their document through the blocks of positions that it
covers, so neither way gathers more than a document, and long documents are spread over blocks until then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspan.operators.prefix import running_total
from quillspan.sources.artifacts import ArtifactError
from quillspan.sources.scratch import materialize

#: Positions of a block.
BLOCK = 1 << 14


def flatten(df: DataFrame, ident: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(values, offsets) of a table with a document a row and arrays of equal length in ``columns`` (null: empty). Ids must differ."""
    sized = df.select(F.col(ident).alias("ident"), *[F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c) for c in columns])
    uneven = F.lit(False)
    for c in columns[1:]:
        uneven |= F.size(c) != F.size(columns[0])
    # places follow from ids and lengths: the arrays are not ordered, and meet their place once
    slim = sized.select("ident", F.size(columns[0]).cast("long").alias("n"), F.lit(1).cast("long").alias("one"), uneven.alias("uneven"))
    placed = materialize(running_total(slim, ["ident"], {"low": "n", "doc": "one"}), "ragged")
    if not placed.where("uneven").isEmpty():
        raise ArtifactError("a document's columns differ in length")
    if placed.select("ident").distinct().count() != placed.count():
        raise ArtifactError("an id is repeated")
    at = placed.select(F.col("ident").alias("_ident"), "low")
    whole = sized.join(at, F.col("ident").eqNullSafe(F.col("_ident")))
    value = F.posexplode(F.arrays_zip(*columns)).alias("i", "v")
    values = whole.select("low", value).select((F.col("low") + F.col("i")).alias("pos"), *[F.col("v")[c].alias(c) for c in columns])
    return values, placed.select("doc", "ident", "low", (F.col("low") + F.col("n")).alias("high"))


def validate(values: DataFrame, offsets: DataFrame) -> None:
    """An error that says what is wrong, unless offsets cover all positions once, in the order of the documents."""
    held = offsets.agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("high").alias("end"), F.count_if(F.col("high") < F.col("low")).alias("turned"), F.count_if(F.col("low").isNull() | F.col("high").isNull() | F.col("doc").isNull()).alias("nulls")).first()
    # different places are counted in bitmaps, a bit a place: places themselves are not shuffled
    marks = values.groupBy(F.bitmap_bucket_number("pos").alias("part")).agg(F.count("*").alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("pos"))).alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    flat = marks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("places").alias("places"), F.min("first").alias("first"), F.max("last").alias("last")).first()
    follow = offsets.select((F.col("doc") + 1).alias("doc"), F.col("high").alias("before")).join(offsets.select("doc", "low"), "doc")
    begin = offsets.where("doc = 0").select("low").first()
    faults = {
        "an offset is missing": held["nulls"] > 0,
        "documents are not numbered from 0 without gaps": held["n"] > 0 and (held["docs"], held["first"], held["last"]) != (held["n"], 0, held["n"] - 1),
        "a document ends before it begins": held["turned"] > 0,
        "the first document does not begin at 0": held["n"] > 0 and (begin is None or begin["low"] != 0),
        "a document does not begin where the one before it ends": not follow.where(F.col("low") != F.col("before")).isEmpty(),
        "positions are not 0, 1, 2, ...": flat["n"] > 0 and (flat["places"], flat["first"], flat["last"]) != (flat["n"], 0, flat["n"] - 1),
        "the offsets do not end with the values": (held["end"] or 0) != flat["n"],
    }
    for fault, found in faults.items():
        if found:
            raise ArtifactError(fault)


def restore(values: DataFrame, offsets: DataFrame) -> DataFrame:
    """(ident, columns as arrays): the table that was flattened; an error where ``validate`` finds one."""
    validate(values, offsets)
    columns = [c for c in values.columns if c != "pos"]
    covered = offsets.where("high > low").select("doc", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK))).alias("block"))
    met = values.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(covered, "block").where("pos >= low and pos < high")
    rows = met.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    return offsets.join(rows, "doc", "left").select("ident", *[F.coalesce(F.col("v")[c], F.array().cast(f"array<{kinds[c]}>")).alias(c) for c in columns])
