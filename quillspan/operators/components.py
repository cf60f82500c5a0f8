"""Connected components over an edge table, without bringing links to the driver.

Alternates the large-star and small-star steps: every step is one shuffle on a node id,
each node's neighbours are only ever folded with ``min`` (no neighbour list is built),
and hot nodes are pre-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspan.sources.scratch import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """(node, low): the smallest neighbour below each node. Written out, so that the joins on it are
    plain scans on that side and a hot node's rows on the other side can be split."""
    return materialize(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")), "cc-low")


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: columns ``node``, ``component`` (the smallest node).

    Null ends and self loops are ignored; repeated edges count once. An empty edge table gives an
    empty result. Each round is written to the shared folder, so a lost executor repeats one round.
    """
    flat = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = materialize(flat.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "cc")
    state = None
    for _ in range(max_rounds):
        # large star: what hung on v hangs on v's smallest neighbour, if v has one below it
        low = _lowest(now)
        large = materialize(now.join(low, F.col("v") == F.col("node"), "left").select("u", F.coalesce("low", "v").alias("v")).distinct(), "cc-large")
        # small star: u and its neighbours below hang on the smallest of them
        low = _lowest(large)
        met = large.join(low, F.col("u") == F.col("node"))
        small = met.select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
        now = materialize(small.where("u <> v").distinct(), "cc")
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (sums["n"], sums["s"]):
            break
        state = (sums["n"], sums["s"])
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = now.select(F.col("v").alias("u")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("u").alias("node"), F.col("u").alias("component"))
    )
