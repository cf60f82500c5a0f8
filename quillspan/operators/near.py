"""Links between similar sets of shingles: MinHash candidates, hubs, exact Jaccard.

Two texts are linked if the Jaccard similarity of their sets of shingles is at least ``THRESHOLD``. Candidates share
one of ``BANDS`` keys of ``ROWS`` MinHash values each; a pair of similarity s is missed with probability
(1 - s^5)^30: 7 in a million at 0.8, less above. Every candidate is confirmed on the shingle sets themselves, so
no link is false.

Buckets are not paired up at once. First each member meets the bucket's hub, the text with most neighbours in
all its buckets; what is linked so forms parts. Only members of different parts of a bucket are still of
interest, and of those only texts that can have a partner: of n shingles m stand in other such texts too,
and a link needs m >= 0.8 n. Pairs across parts are tried in the join itself, against the most they can share,
min(m, m') of n + n' - min(m, m'), and by sketches of 4,096 MinHash bits, of which similar texts differ in a tenth
at most (the bound allows five deviations more: it loses 3 links in ten million at 0.8, less above). What passes is
compared shingle by shingle. So a group of near copies is linked through its hub, texts at its rim are dropped by
their own shingles, and rows are made for pairs near the threshold only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspan.operators.components import connected_components
from quillspan.operators.keyfilter import key_filter, split
from quillspan.sources.scratch import discard, materialize

SEED, THRESHOLD = 42, 0.8
#: Times that texts without a possible partner are dropped before pairs are tried.
PRUNES = 2
BANDS, ROWS = 30, 5
#: Shingles that are mapped at once: their values (150 KB) stay in the processor's cache.
CHUNK = 128
#: Hashes of texts that share a bucket, and shingles of compared texts, are broadcast up to so many (10 MB), and
#: joined by shuffle beyond.
BROADCAST_TEXTS, BROADCAST_SHINGLES = 1_250_000, 1_250_000
#: Bits of a sketch, and in how many similar texts may differ: (1 - 0.8) / 2 of them and five deviations.
SKETCH = 4096
SKETCH_DIFFER = int(SKETCH * 0.1 + 5 * (SKETCH * 0.09) ** 0.5)


def _maps(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 64, size=(2, n), dtype=np.uint64)
    return a | np.uint64(1), b


def band_keys(shingles: np.ndarray, maps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One key a band, from the least values of its maps."""
    a, b = maps
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, (shingles[at : at + CHUNK, None] * a + b).min(axis=0), out=least)
    each = least.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys ^ each[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


Shingler = Callable[[str | None], np.ndarray]


def signatures(rows: DataFrame, shingler: Shingler, **more: Callable[[np.ndarray], int]) -> DataFrame:
    """``rows`` (..., text) with keys in place of text: one a band, from the text's shingles; none without shingles. ``more`` names
    further numbers that are made of the shingles."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = _maps(BANDS * ROWS)
        for b in batches:
            made = []
            for x in b.column("text"):
                s = shingler(x.as_py())
                made.append((band_keys(s, maps) if len(s) else [], *(f(s) for f in more.values())))
            keys, *rest = zip(*made, strict=True) if made else [()] * (1 + len(more))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(keys, pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in rest)], [*others, "keys", *more])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others), "keys array<long>", *(f"{c} long" for c in more)]))


def shingle_sets(rows: DataFrame, shingler: Shingler, wanted: DataFrame) -> DataFrame:
    """(h, s): the shingle hashes of the texts (h, text) that are in ``wanted`` (h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingler(x.as_py()).view(np.int64) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(sets, pa.list_(pa.int64()))], ["h", "s"])

    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    own = rows.select("h", "text").join(wanted, "h", "left_semi")
    return own.mapInArrow(run, f"h {rows.schema['h'].dataType.simpleString()}, s array<long>").dropDuplicates(["h"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the pairs whose sets are similar enough. ``sets``: (h, n, s), s the shingles that others may share of n."""
    if (sets.agg(F.sum(F.size("s"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        sets = F.broadcast(sets)
    l, r = sets.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), sets.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = pairs.join(l, "a").join(r, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("c"))
    return both.where(_enough(F.col("c"), F.col("n"))).select("a", "b")


def _enough(shared: Column, both: Column) -> Column:
    """Whether ``shared`` shingles of two sets, ``both`` in size together, reach the threshold."""
    return shared >= THRESHOLD * (both - shared) - 1e-9


def sketch(shingles: np.ndarray, maps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One bit of the least value of each map, as longs."""
    a, b = maps
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 128):
        np.minimum(least, (shingles[at : at + 128, None] * a + b).min(axis=0), out=least)
    return np.packbits((least >> np.uint64(17)) & np.uint64(1)).view(np.int64)


def _sketched(sets: DataFrame) -> DataFrame:
    """(h, bits) of texts (h, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = _maps(SKETCH)
        for b in batches:
            bits = [sketch(x.values.to_numpy().view(np.uint64), maps) for x in b.column("s")]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(bits, pa.list_(pa.int64()))], ["h", "bits"])

    return sets.select("h", "s").mapInArrow(run, f"h {sets.schema['h'].dataType.simpleString()}, bits array<long>")


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _mixed(named: DataFrame, tag: str) -> DataFrame:
    """The rows of ``named`` (key, h, part, ...) in buckets of several parts."""
    keys = named.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    # written, so that the rows of a hot key can be split where they meet it
    return materialize(named.join(materialize(keys, f"{tag}-keys"), "key"), tag)


def _linkable(named: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``named`` with n and m, without texts that no other text of a mixed bucket can be similar to; and the sets
    without shingles of one text only."""
    own = materialize(sets.join(named.select("h").distinct(), "h"), "near-own")
    each = own.select("h", F.explode("s").alias("x"))
    several = each.groupBy("x").agg(F.count("*").alias("df")).where("df > 1").select("x")
    trimmed = each.join(several, "x").groupBy("h").agg(F.collect_list("x").alias("s"), F.count("*").alias("m"))
    trimmed = materialize(trimmed.join(own.select("h", "n"), "h").where(F.col("m") >= THRESHOLD * F.col("n") - 1e-9), "near-trimmed")
    return _mixed(named.select("key", "h", "part").join(trimmed.select("h", "n", "m"), "h"), "near-linkable"), trimmed.select("h", "n", "s")


def links(keyed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], candidates: DataFrame | None = None) -> DataFrame:
    """(a, b): linked texts, enough of them to give every component. ``keyed``: (h, keys) of every row, equal texts
    with equal h; ``sets_of``: from the (h) of some texts, (h, s) of each, once. ``candidates``: pairs (a, b), a < b, that are
    known from elsewhere; they are confirmed with the hubs' pairs, and what they link is not tried again."""
    rows = keyed.select("h", F.explode("keys").alias("key"))
    # keys of several texts; equal texts count as often as they stand, which only weighs hubs
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    sizes = materialize(sizes.select("key", "n"), "near-sizes")
    shared, _ = split(rows, key_filter(sizes, "key"), "key")
    met = materialize(shared.join(sizes, "key").distinct(), "near-met")
    degree = materialize(met.groupBy("h").agg(F.sum("n").alias("degree")), "near-degrees")
    wanted = degree.select("h")
    if candidates is not None:
        wanted = wanted.unionByName(candidates.select(F.explode(F.array("a", "b")).alias("h"))).distinct()
    sets = materialize(sets_of(wanted).withColumn("n", F.size("s")), "near-sets")
    hubs = met.join(degree, "h").groupBy("key").agg(F.max(F.struct("degree", "h"))["h"].alias("hub"))
    stars = met.join(materialize(hubs, "near-hubs"), "key").where("h <> hub").select(*_ordered("h", "hub"))
    stars = (stars if candidates is None else stars.unionByName(candidates)).distinct()
    near = materialize(confirmed(stars, sets), "near-stars")
    parts = connected_components(near, "a", "b")
    named = met.select("key", "h").join(parts, F.col("h") == F.col("node"), "left").select("key", "h", F.coalesce("component", "h").alias("part"))
    whole = materialize(named, "near-named")
    named = _mixed(whole, "near-across")
    discard(met, sizes, whole)
    for _ in range(PRUNES):
        named, own = _linkable(named, sets)
    named = materialize(named.join(_sketched(sets.join(own.select("h"), "h", "left_semi")), "h"), "near-sketched")
    l, r = (named.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("part", "h", "n", "m", "bits")]) for i in (1, 2))
    differ = F.aggregate(F.zip_with("bits1", "bits2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    close = (F.col("part1") < F.col("part2")) & _enough(F.least("m1", "m2"), F.col("n1") + F.col("n2")) & (differ <= SKETCH_DIFFER)
    tried = materialize(l.alias("l").join(r.alias("r"), (F.col("l.key") == F.col("r.key")) & close).select(*_ordered("h1", "h2")).distinct(), "near-tried")
    across = materialize(confirmed(tried, own), "near-links")
    discard(sets, named, tried)
    return near.unionByName(across)
