"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of ``documents``; the last returns each document's tokens.

Defined results, of every stage: an empty table gives an empty one with the stage's columns; columns beyond those of
``documents`` come along, whatever their names (the last stage returns its four only); a null id or source is a
value like any other; ``n_chars``, where there is such a column, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspan.llm import byte_bpe, mixing, near_copies, quality_rules, substring_dedup
from quillspan.sources.scratch import discard, materialize

#: Rows of an Arrow batch in the stages that read whole texts in Python. Executors hold some batches outside their heap,
#: so the default of 10,000 texts costs half a GB more. ``run`` puts the setting back.
BATCH_SETTING, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without lines above their host's limit.

    A null or empty text fails the base rules and goes; texts of any length are judged whole; of the documents that
    hold a line above its limit the one with the smallest id keeps it (all rows that repeat it do); repeated rows stay."""
    return quality_rules.filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more.

    The one with the smallest id stays (of equal ids that of least text hash; a null id only if there is no other);
    of repeated rows one stays; null texts and those without words are one group; texts of any length are compared whole."""
    spark.conf.set(BATCH_SETTING, TEXT_ROWS)
    return near_copies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words under windows that start elsewhere too.

    Every document stays, be its text null, empty, shorter than a window or without a word left; repeated rows count
    as elsewhere for each other, so both lose what they share."""
    spark.conf.set(BATCH_SETTING, TEXT_ROWS)
    return substring_dedup.remove(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 2 times.

    A null or empty text has no words and is not taken; null sources are one source; rows that repeat a document share
    its rank and are taken one by one, equal ranks by size, text and id."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of each document of the mix; the ids are decoded and must give the text.

    A null text has no tokens; a text of any length has the ids of the whole; repeated rows each give a row."""
    import public_tokenizers

    spark.conf.set(BATCH_SETTING, TEXT_ROWS)
    ids = byte_bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, check=True)
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("substring dedup", repeats), ("mixing", mix), ("byte-level BPE", tokenize)]

#: Near-dedup, substring dedup and BPE are not expressible together in one SQL statement; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again by the next."""
    docs, before, rows = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            if before is not None:
                discard(before)
            before = docs
    finally:
        spark.conf.set(BATCH_SETTING, rows)
    return docs
