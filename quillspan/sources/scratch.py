"""Lineage cuts that survive the loss of an executor.

Intermediate tables go, as Parquet, to the folder that the cluster names in ``spark.checkpoint.dir``. Only in
local mode, and only where that setting is absent (tests, a laptop), is a local folder chosen, once per
session; on a cluster its absence is an error, as executors share no local folder. A table that is no longer
read can be discarded at once; what is left goes when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read and write."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillspan-")
    return _OWN[app]


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _root(spark: SparkSession) -> str:
    """This application's own folder, which is removed when the driver's JVM ends."""
    root = f"{shared_folder(spark)}/quillspan/{spark.sparkContext.applicationId}"
    if _ROOTS.get(spark.sparkContext.applicationId) != root:
        files, where = _hadoop(spark, root)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _ROOTS[spark.sparkContext.applicationId] = root
    return root


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it back.

    The schema is carried over, so an empty frame comes back with its columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through the Hadoop file system that holds it."""
    files, where = _hadoop(spark, path)
    files.delete(where, True)
