"""Fixed values and schemas of the relations."""

from __future__ import annotations

from pyspark.sql import types as T

#: The entity labels, in their order.
LABELS = ("NAME", "DATE", "EMAIL", "PHONE", "ADDRESS", "USERNAME", "JOB_TITLE")
#: The BIO tags, O first, then B and I of each label.
TAGS = ("O", *(f"{p}-{x}" for x in LABELS for p in "BI"))
#: Longest span in tokens.
MAX_WIDTH = 16

SEGMENTS = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("segment_index", T.IntegerType()), T.StructField("text", T.StringType())])
SPAN_LABELS = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start_offset", T.IntegerType()), T.StructField("end_offset", T.IntegerType())])
ENTITY = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
GOLD = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("full_text", T.StringType()), T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("expected_entity_count", T.IntegerType())])
TEST = T.StructType([GOLD["document_id"], GOLD["full_text"], GOLD["expected_entity_count"]])
TEST_SLOTS = T.StructType([T.StructField("row_order", T.LongType()), T.StructField("row_id", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("slot", T.LongType())])
WEAK = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("full_text", T.StringType()), T.StructField("weak_entities", T.ArrayType(ENTITY)), T.StructField("annotation_source", T.StringType())])
METADATA = T.StructType([T.StructField("document_id", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("channel", "domain")), *(T.StructField(c, T.IntegerType()) for c in ("n_chars", "n_segments", "n_words", "n_nonempty_segments")), T.StructField("source_system", T.StringType()), T.StructField("ingested_at", T.TimestampType())])
