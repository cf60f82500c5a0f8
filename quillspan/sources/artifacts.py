"""Builds that are hashed, verified, published once, and read for stated purposes only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillspan.operators.audit import same_rows
from quillspan.schemas import GOLD, TEST, TEST_SLOTS
from quillspan.sources.scratch import delete


class ArtifactError(ValueError):
    """An artifact is missing, changed, or asked for a purpose it is not for."""


#: Which purposes may read which part.
PURPOSES = {
    "train": frozenset({"fit", "train", "audit"}), "dev": frozenset({"evaluate", "tune", "audit"}), "holdout": frozenset({"final_evaluation"}),
    "test": frozenset({"predict", "audit"}), "test_slots": frozenset({"predict", "audit"}),
}
SCHEMAS = {"train": GOLD, "dev": GOLD, "holdout": GOLD, "test": TEST, "test_slots": TEST_SLOTS}


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file under a path, hashed where it lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").split("://")[-1].lstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted names and hashes of a path's files."""
    rows = inventory(spark, path).select(F.concat_ws(":", F.regexp_extract("name", r"([^/]*)$", 1), "sha256").alias("x"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256)).first()[0]


def verify(df: DataFrame, expected: DataFrame, key: str | None = None) -> None:
    """Schema, keys and every cell as expected; else an error that says what differs."""
    plain = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
    if plain(df.schema) != plain(expected.schema):
        raise ArtifactError("the schema differs")
    if key:
        if not df.groupBy(key).count().where("count > 1").isEmpty():
            raise ArtifactError("an id is repeated")
        if not df.select(key).exceptAll(expected.select(key)).isEmpty() or not expected.select(key).exceptAll(df.select(key)).isEmpty():
            raise ArtifactError("the ids differ")
    if not same_rows(df, expected):
        raise ArtifactError("a cell differs")


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, sources: dict[str, str] | None = None, keys: dict[str, str] | None = None) -> dict:
    """Write tables to a staging path, read them back and compare, add a manifest, and rename to ``path``.

    ``sources`` are paths whose digests are taken before and after; a change in between is an error. A path
    that exists is verified against its manifest instead, and never written.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(where):
        return check_build(spark, path)
    before = {n: digest(spark, p) for n, p in (sources or {}).items()}
    stage = f"{path.rstrip('/')}.staging"
    if fs.exists(jvm.org.apache.hadoop.fs.Path(stage)):
        delete(spark, stage)
    files = {}
    for name, df in tables.items():
        at = f"{stage}/{name}.parquet"
        df.write.option("compression", "zstd").parquet(at)
        back = spark.read.parquet(at)
        verify(back, df, (keys or {}).get(name))
        files[name] = {"sha256": digest(spark, at), "rows": back.count(), "schema": back.schema.simpleString()}
    if before != {n: digest(spark, p) for n, p in (sources or {}).items()}:
        delete(spark, stage)
        raise ArtifactError("a source changed during the build")
    manifest = {"format_version": 1, "sources": before, "files": files}
    spark.range(1).select(F.lit(json.dumps(manifest, sort_keys=True)).alias("value")).coalesce(1).write.text(f"{stage}/manifest")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(stage), where):
        raise ArtifactError("the build could not be published")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}/manifest").first()[0])


def check_build(spark: SparkSession, path: str) -> dict:
    """The manifest of a build, after every part has been compared with it."""
    manifest = read_manifest(spark, path)
    for name, stated in manifest["files"].items():
        at = f"{path.rstrip('/')}/{name}.parquet"
        if digest(spark, at) != stated["sha256"]:
            raise ArtifactError(f"{name} has changed")
    present = {r["name"].split("/")[0].removesuffix(".parquet") for r in inventory(spark, path).select("name").toLocalIterator()} - {"manifest"}
    if present != set(manifest["files"]):
        raise ArtifactError(f"the build holds {sorted(present)}")
    return manifest


class PreparedData:
    """A published build, read by purpose. Hash, row count and schema of a part are checked on every read, the
    schema also against this package's own copy."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = read_manifest(spark, path)

    def load(self, part: str, purpose: str, allow_final_evaluation: bool = False) -> DataFrame:
        if part not in PURPOSES or "/" in part or ".." in part:
            raise ArtifactError(f"no part {part}")
        if purpose not in PURPOSES[part]:
            raise ArtifactError(f"{part} is not for {purpose}")
        if part == "holdout" and not allow_final_evaluation:
            raise ArtifactError("the holdout needs leave for the final evaluation")
        stated = self.manifest["files"].get(part)
        at = f"{self.path}/{part}.parquet"
        if stated is None or digest(self.spark, at) != stated["sha256"]:
            raise ArtifactError(f"{part} is missing or has changed")
        df = self.spark.read.parquet(at)
        kinds = lambda s: T.StructType([T.StructField(f.name, f.dataType) for f in s]).simpleString()
        if df.schema.simpleString() != stated["schema"] or kinds(df.schema) != kinds(SCHEMAS[part]):
            raise ArtifactError(f"{part} has another schema")
        if df.count() != stated["rows"]:
            raise ArtifactError(f"{part} has another number of rows")
        return df
