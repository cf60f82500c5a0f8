"""The reference relations, made from the driver's tables.

``documents`` gives segments (its lines), metadata (source as channel, lang as domain) and texts. Gold spans
are capitalized ASCII words of four letters and more, labelled by length; predictions, candidates and scores
follow from the spans' offsets by arithmetic, so that SQL can make the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspan.operators.candidates import tokenize
from quillspan.operators.reassembly import explode_lines
from quillspan.schemas import LABELS


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(read(spark, sf_dir, "documents"))


def label_of(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), F.pmod(index, F.lit(len(LABELS))).cast("int") + 1)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end, label, value)."""
    words = tokenize(read(spark, sf_dir, "documents"), pattern=r"(?<![^ \n])[A-Z][a-z]{3,}(?![^ \n])")
    return words.select("doc_id", "start", "end", label_of(F.length("token")).alias("label"), F.col("token").alias("value"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold of one or two words: a gold word, with the word after it if that has one to five small letters and one space is between."""
    found = tokenize(read(spark, sf_dir, "documents"), pattern=r"(?<![^ \n])[A-Z][a-z]{3,}(?: [a-z]{1,5}(?![^ \n])|(?![^ \n]))")
    return found.select("doc_id", "start", "end", label_of(F.length(F.substring_index("token", " ", 1))).alias("label"), F.col("token").alias("value"))


def _predicted(s: Column) -> tuple[Column, Column, Column]:
    """Whether a gold span is predicted, with which end, and with which label."""
    end = F.when(s % 13 == 0, F.col("end") - 1).otherwise(F.col("end"))
    return s % 9 != 0, end, F.when(s % 11 == 0, label_of(F.length("value") + 1)).otherwise(F.col("label"))


def predicted(gold: DataFrame, salt: int = 0) -> DataFrame:
    """(doc_id, start, end, label): gold spans, some dropped, some relabelled, some a character short."""
    keep, end, label = _predicted(F.col("start") + salt)
    return gold.where(keep).select("doc_id", "start", end.alias("end"), label.alias("label"))


def candidates(gold: DataFrame) -> DataFrame:
    """Predictions and most gold spans, with a score; both come from one reading of the gold spans."""
    row = lambda keep, end, label: F.when(keep, F.struct(F.col("start"), end.alias("end"), label.alias("label")))
    both = F.array(row(*_predicted(F.col("start"))), row(F.col("start") % 17 != 0, F.col("end"), F.col("label")))
    every = gold.select("doc_id", F.inline(F.filter(both, lambda x: x.isNotNull()))).distinct()
    return every.withColumn("score", (F.pmod(F.col("start") * 31 + F.col("end") * 7, F.lit(97)) + 1) / 99.0)


#: SQL for the same relations, as common table expressions.
SQL = """
tok AS (
  SELECT doc_id, w, (e - length(w))::INT AS s, e FROM (
    SELECT doc_id, w, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i))::INT - 1 AS e FROM (
      SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '[ \\n]') AS ws FROM documents)))
), gold AS (
  SELECT doc_id, s AS start, e AS "end", ['NAME','DATE','EMAIL','PHONE','ADDRESS','USERNAME','JOB_TITLE'][(length(w) % 7 + 1)::INT] AS label, w AS value
  FROM tok WHERE regexp_full_match(w, '[A-Z][a-z]{3,}')
), pred AS (
  SELECT doc_id, start, CASE WHEN start % 13 = 0 THEN "end" - 1 ELSE "end" END AS "end",
    CASE WHEN start % 11 = 0 THEN ['NAME','DATE','EMAIL','PHONE','ADDRESS','USERNAME','JOB_TITLE'][((length(value) + 1) % 7 + 1)::INT] ELSE label END AS label
  FROM gold WHERE start % 9 <> 0
), pred2 AS (
  SELECT doc_id, start, CASE WHEN (start + 5) % 13 = 0 THEN "end" - 1 ELSE "end" END AS "end",
    CASE WHEN (start + 5) % 11 = 0 THEN ['NAME','DATE','EMAIL','PHONE','ADDRESS','USERNAME','JOB_TITLE'][((length(value) + 1) % 7 + 1)::INT] ELSE label END AS label
  FROM gold WHERE (start + 5) % 9 <> 0
), cand AS (
  SELECT *, ((start * 31 + "end" * 7) % 97 + 1) / 99.0::DOUBLE AS score FROM (
    SELECT doc_id, start, "end", label FROM pred UNION SELECT doc_id, start, "end", label FROM gold WHERE start % 17 <> 0)
), gs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label)::INT AS slot FROM gold
), ps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label)::INT AS slot FROM pred
), ps2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label)::INT AS slot FROM pred2)
"""
#: SQL for gold of one or two words.
PHRASES = r"""
two AS (
  SELECT t.doc_id, s AS start, e AS "end", w, CASE WHEN regexp_full_match(n, '[a-z]{1,5}') AND ns = e + 1 AND substr(text, e + 1, 1) = ' ' THEN w || ' ' || n ELSE w END AS value
  FROM (SELECT doc_id, w, s, e, lead(w) OVER o AS n, lead(s) OVER o AS ns FROM tok WHERE w <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY s)) t JOIN documents USING (doc_id) WHERE regexp_full_match(w, '[A-Z][a-z]{3,}')
), phrases AS (
  SELECT doc_id, start, (start + length(value))::INT AS "end", ['NAME','DATE','EMAIL','PHONE','ADDRESS','USERNAME','JOB_TITLE'][(length(w) % 7 + 1)::INT] AS label, value FROM two
)"""
