"""An extension: segments that arrive as a stream become documents once their lines are complete.

``upsert_batches`` keeps every segment it has seen beside its target, dealt by document into ``BUCKETS``
folders, so lines of one document may come in any batch and any order. A batch touches only its documents'
buckets: their segments are read, the documents put together anew, and the buckets' documents replaced. What a
batch writes depends on its number and on earlier batches alone, so a batch that is run again gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.operators.reassembly import reassemble
from quillspan.sources.scratch import delete, discard, materialize

BUCKETS = 64


def segment_stream(spark, path: str, schema: str = "doc_id long, segment_index int, text string, ts timestamp") -> DataFrame:
    """Segments from Parquet files as they land."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_documents(segments: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Documents per event-time window, once the watermark has passed it: lines in order, their number, and
    whether indices are complete. State is bounded by the watermark."""
    per = segments.withWatermark("ts", late).groupBy(F.window("ts", window), "doc_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "text"))).alias("parts"), F.max("segment_index").alias("high"))
    return per.select("window", "doc_id", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("full_text"), F.size("parts").alias("n_segments"), (F.size("parts") == F.col("high") + 1).alias("contiguous"))


def _bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(BUCKETS)).cast("int")


def _replace(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _read(spark, path: str, schema: str) -> DataFrame:
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def upsert_batches(segments: DataFrame, target: str, checkpoint: str):
    """A query that keeps ``target`` at the documents whose lines 0..n-1 have all come so far; returns the started query.

    A document that grows replaces its row; one that has a gap (again) has none. A segment that comes twice counts
    once; of different texts for one index the latest batch's counts, in a batch the greatest. Segments without
    doc_id or index are left out. ``target`` has the columns of ``reassemble`` and the bucket.
    """
    kept = f"{target}/_segments"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        kind = df.schema["doc_id"].dataType.simpleString()
        new = df.where("doc_id is not null and segment_index is not null").select("doc_id", F.col("segment_index").cast("int"), "text", _bucket(F.col("doc_id")).alias("bucket"), F.lit(number).cast("long").alias("batch"))
        _replace(new, kept, "bucket", "batch")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        if not touched:
            return
        every = _read(spark, kept, f"doc_id {kind}, segment_index int, text string, bucket int, batch long").where(F.col("bucket").isin(touched) & (F.col("batch") <= number))
        one = every.groupBy("doc_id", "segment_index").agg(F.max(F.struct("batch", "text"))["text"].alias("text"))
        whole = materialize(reassemble(one).where("contiguous").withColumn("bucket", _bucket(F.col("doc_id"))), "streamed")
        _replace(whole, target, "bucket")
        full = {r[0] for r in whole.select("bucket").distinct().collect()}
        for b in set(touched) - full:  # no document is whole there any more
            delete(spark, f"{target}/bucket={b}")
        discard(whole)

    return segments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
