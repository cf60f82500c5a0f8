"""Rebuilding documents from shuffled line segments, and profiling the segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspan.functions.text import strip, words


def explode_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, segment_index, text): the lines of each text."""
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("segment_index", "text"))


def reassemble(segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document: its text, lines in order joined by newlines, and the counts recomputed from it.

    ``contiguous`` says whether the indices are exactly 0..n-1, each once. Lines are gathered by document, so
    a group is one document; null lines count as empty ones.
    """
    lines = segments.withColumn("text", F.coalesce("text", F.lit("")))
    rows = lines.groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct("segment_index", "text"))).alias("parts"),
        F.count("*").cast("int").alias("n_segments"),
        F.count_if(strip(F.col("text")) != "").cast("int").alias("n_nonempty_segments"),
        F.min("segment_index").alias("low"), F.max("segment_index").alias("high"), F.count_distinct("segment_index").alias("kinds"),
    )
    ok = (F.col("low") == 0) & (F.col("high") == F.col("n_segments") - 1) & (F.col("kinds") == F.col("n_segments"))
    full = rows.select(doc, F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("full_text"), "n_segments", "n_nonempty_segments", ok.alias("contiguous"))
    return full.withColumns({"n_chars": F.length("full_text"), "n_words": F.size(words(F.col("full_text")))})


def metadata_mismatches(documents: DataFrame, metadata: DataFrame, fields: list[str], doc: str = "doc_id") -> DataFrame:
    """(field, documents, mismatches): recomputed counts against those stated."""
    both = documents.alias("d").join(metadata.alias("m"), doc)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (~F.col(f"d.{c}").cast("long").eqNullSafe(F.col(f"m.{c}").cast("long"))).alias("bad")) for c in fields])).alias("x")
    return both.select(each).groupBy("x.field").agg(F.count("*").alias("documents"), F.count_if(F.col("x.bad")).alias("mismatches"))


def segment_profile(segments: DataFrame) -> DataFrame:
    """One row of counts: empty lines, lines of white space only, documents with non-ASCII text or carriage returns."""
    t = F.coalesce("text", F.lit(""))
    per = segments.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(t == "").alias("empty"), F.count_if((t != "") & (strip(t) == "")).alias("blank"),
        F.max(t.rlike(r"[^\x00-\x7F]")).alias("non_ascii"), F.max(t.contains("\r")).alias("cr"), F.max(t.contains("\n")).alias("newline"),
    )
    return per.agg(F.sum("n").alias("segments"), F.sum("empty").alias("empty_segments"), F.sum("blank").alias("blank_segments"), F.count_if("non_ascii").alias("non_ascii_documents"), F.count_if("cr").alias("cr_documents"), F.count_if("newline").alias("newline_documents"))
