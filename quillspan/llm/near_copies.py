"""Near-duplicates of whole texts: five-word shingles, MinHash candidates, exact Jaccard of 0.8 or more.

Fingerprints of the shingles meet along the chains of the pigeonring (``simhash``), and what they link is confirmed on
the sets of five-word shingles (A-Z lower-cased). Two bits do not reach every pair: at 0.8 a fair part of a
fingerprint's bits differ, and at so wide a radius a chain's first segments have a few bits, too few to select candidates
by (figures in the README). So the MinHash candidates of ``operators.near`` come beside them, confirmed alike.

Defined results: exact copies are one node; a null text, or one without words, has one empty shingle; fewer
than five words form one shingle; of each group the document with the smallest id stays (then of least text
hash), a null id only if all are null; of rows that repeat it, one; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quillspan.llm import simhash
from quillspan.llm.simhash import _text
from quillspan.operators import near
from quillspan.operators.components import connected_components
from quillspan.operators.keyfilter import key_filter, split
from quillspan.sources.scratch import materialize

SHINGLE = 5


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, near.SEED) for s in parts), dtype=np.uint64))


def ring_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b), a < b: texts whose fingerprints the pigeonring links. ``keyed``: (h, fp) of every row. Of the texts under one
    fingerprint the least stands for it, and the others are its partners."""
    texts = keyed.select("h", "fp").distinct()
    owners = materialize(texts.groupBy("fp").agg(F.min("h").alias("low")), "near-fingerprints")
    alike = texts.join(owners, "fp").where("h <> low").select(F.col("low").alias("a"), F.col("h").alias("b"))
    a, b = (owners.select(F.col("fp").alias(x), F.col("low").alias(f"h{x}")) for x in "ab")
    apart = simhash.links(owners.select("fp")).distinct().join(a, "a").join(b, "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    return materialize(alike.unionByName(apart), "near-ring")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group of near duplicates, all columns.

    Only texts of groups with several rows are shuffled, and once: the rows that repeat a kept document meet on the
    join's own key."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(_text(text)).alias("h"), _text(text).alias("text"))
    keyed = materialize(near.signatures(slim, shingle_set, fp=simhash.folded), "near-keys")
    links = near.links(keyed.select("h", "keys"), lambda wanted: near.shingle_sets(slim, shingle_set, wanted), ring_pairs(keyed))
    found = connected_components(links, "a", "b")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    roots = materialize(keyed.select("doc_id", "h").join(found, F.col("h") == F.col("node"), "left").select("doc_id", "h", F.coalesce("component", "h").alias("root")), "near-roots")
    groups = materialize(roots.groupBy("root").agg(F.min(order).alias("x"), F.count("*").alias("n")).where("n > 1").select("root", "x"), "near-groups")
    name = lambda d: (_id(d).alias("_d"), d.isNull().alias("_none"))
    first = F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("h") == F.col("x.h"))
    verdict = materialize(roots.join(groups, "root").select(*name(F.col("doc_id")), F.col("h").alias("_h"), first.alias("_first")).distinct(), "near-verdicts")
    own = docs.select(*[F.col(f"`{c}`").alias(f"x_{i}") for i, c in enumerate(docs.columns)])
    d, t = f"x_{docs.columns.index(doc_id)}", f"x_{docs.columns.index(text)}"
    own = own.withColumns({"_d": _id(F.col(d)), "_none": F.col(d).isNull(), "_h": F.xxhash64(_text(t))})
    key = ["_d", "_none", "_h"]
    some, alone = split(own, key_filter(verdict, *key), *key)
    kept = some.join(verdict, key, "left").where(F.coalesce("_first", F.lit(True)))
    columns = [f"x_{i}" for i in range(len(docs.columns))]
    one = kept.groupBy(*key).agg(F.first(F.struct(*columns)).alias("x")).select("x.*")
    return one.unionByName(alone.select(*columns)).toDF(*docs.columns)



def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(0).cast("long"))
