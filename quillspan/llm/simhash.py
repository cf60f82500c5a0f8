"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 64-bit SimHash over three-word shingles. Links: fingerprints that differ in at most 2 bits.
The 64 bits form a ring of five segments. If two fingerprints differ in at most 2 bits, some segment
starts a chain along the ring whose first k segments together differ in at most 2k/5 bits, for every k:
so the first two are equal (the join key), the first three and four differ in at most 1, all five in at
most 2. Candidates meet on the key and are pruned along the chain before the full count.

A bucket of more than ``BUCKET`` distinct fingerprints is not paired up. Two fingerprints differ in at
most 2 bits exactly if some value is within 1 bit of both, so each member is sent to the values within
1 bit of it (outside the key's bits) and meets at most 38 others there, linked as a star: all links' components, without
the square of a group.

Components run over distinct fingerprints, so exact copies cost one row.

Defined results: a null text, or one without words, has fingerprint zero and is linked like any other;
fewer than three words form one shingle; repeated rows each give a row; a null ``doc_id`` takes part but
is never a component's id unless all its ids are null; an empty table gives an empty result; extra
columns are ignored (or kept, by ``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspan.operators.components import connected_components
from quillspan.sources.scratch import materialize

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Bits of the ring's segments, from the lowest bit up.
SEGMENTS = (13, 13, 13, 13, 12)
BUCKET = 64


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit number."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(w, w[1:], w[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    return folded(np.fromiter((digest(s, SEED) for s in parts), dtype="<u8"))


def folded(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes, signed."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, h, fp) for every row; h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array([fingerprint(x.as_py()) for x in b.column("text")], pa.int64())], ["doc_id", "h", "fp"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(_text(text)).alias("h"), _text(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, h long, fp long")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _masks() -> list[int]:
    starts = np.cumsum([0, *SEGMENTS])
    return [((1 << n) - 1) << int(s) for n, s in zip(SEGMENTS, starts, strict=False)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def keyed(distinct: DataFrame) -> DataFrame:
    """(ring, key, fp): one row for each place on the ring, keyed by two neighbouring segments."""
    masks = _masks()
    pair = lambda i: masks[i] | masks[(i + 1) % 5]
    keys = F.array(*[F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(_long(pair(i))).alias("key")) for i in range(5)])
    return distinct.select(F.explode(keys).alias("k"), "fp").select("k.ring", "k.key", "fp")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): fingerprints that are linked, enough of them to give every component."""
    masks = _masks()
    rows = keyed(distinct)
    sizes = materialize(rows.groupBy("ring", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    rows = materialize(rows.join(sizes, ["ring", "key"]), "simhash-buckets")
    small, large = rows.where(F.col("n") <= BUCKET), rows.where(F.col("n") > BUCKET)
    differ = lambda k: F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp")).bitwiseAND(
        F.element_at(F.array(*[_long(_union(masks, i, k)) for i in range(5)]), F.col("l.ring") + 1)))
    on = (F.col("l.ring") == F.col("r.ring")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))
    on = on & (differ(3) <= 1) & (differ(4) <= 1) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= MAX_BITS)
    pairs = small.alias("l").join(small.alias("r"), on).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    outside = F.element_at(F.array(*[F.array(*[_long(1 << b) for b in range(64) if not (masks[i] | masks[(i + 1) % 5]) >> b & 1], _long(0)) for i in range(5)]), F.col("ring") + 1)
    near = large.select("fp", F.explode(outside).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("mid"))
    stars = near.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def _union(masks: list[int], i: int, k: int) -> int:
    out = 0
    for j in range(k):
        out |= masks[(i + j) % 5]
    return out


def _placed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, h, fp, root, component_id) for every row."""
    fps = materialize(fingerprints(docs, text, doc_id), "simhash")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    found = connected_components(links(distinct.select("fp")), "a", "b")
    own = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    ids = materialize(own.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-ids")
    named = materialize(own.join(ids, "root").select(F.col("fp").alias("f"), "root", "component_id"), "simhash-named")
    return fps.join(named, F.col("fp") == F.col("f")).drop("f")


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row."""
    return _placed(docs, text, doc_id).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, all columns: the one with the smallest id (then of least text hash); of
    rows that repeat it, one."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = _placed(docs, text, doc_id).groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("_d"), F.col("x.h").alias("_h"))
    own = docs.select(*[F.col(f"`{c}`").alias(f"x_{i}") for i, c in enumerate(docs.columns)])
    d, t = f"x_{docs.columns.index(doc_id)}", f"x_{docs.columns.index(text)}"
    kept = own.join(first, F.col(d).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(_text(t)) == F.col("_h")), "left_semi")
    return kept.dropDuplicates([d, t]).toDF(*docs.columns)
