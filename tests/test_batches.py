"""Length batches, best rows of a key, pairs and families across a split, ragged tables."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import batches, decode, near, similarity
from quillspan.plans import spans
from quillspan.sources import ragged
from quillspan.sources.artifacts import ArtifactError
from quillspan.sources.scratch import materialize
from tests.conftest import DATA


def test_batches_keep_to_the_budget_and_waste_little(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.lognormvariate(4, 1.5)) if i % 40 else (0 if i % 80 else None), "x") for i in range(3000)] + [(9000, 5000, "x")] * 3
    df = spark.createDataFrame(rows, "id int, n int, batch_ string").repartition(5)
    got = batches.length_batches(df, "n", "id", 1000).collect()
    assert len(got) == len(rows) and all((r["batch"] is None) == (not r["n"]) for r in got)
    held = {}
    for r in got:
        if r["batch"] is not None:
            held.setdefault(r["batch"], []).append(r["n"])
    assert all(len(v) == 1 or max(v) * len(v) <= 1000 for v in held.values()) and sorted(held) == list(range(len(held)))
    assert all(max(v) - min(v) < max(v) / 8 for v in held.values())
    # no class leaves more than one batch that another row would fit into
    classes = {}
    for v in held.values():
        c = min(v) - min(v) % (1 << max(0, min(v).bit_length() - 4))
        classes.setdefault(c, []).append(v)
    assert all(sum(len(v) < 1000 // max(map(max, vs)) for vs in [vs] for v in vs) <= 1 for vs in classes.values() if max(map(max, vs)) <= 1000)
    assert batches.length_batches(df.limit(0), "n", "id", 1000).collect() == []


def test_best_rows_of_a_hot_key_are_cut_before_the_shuffle(spark):
    rows = spark.range(0, 20000, 1, 6).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), (F.col("id") * 37 % 1009).alias("v"), "id")
    got = batches.best_per_key(rows, ["k"], [F.desc("v"), F.col("id")], 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    want = {}
    for r in rows.collect():
        want.setdefault(r["k"], []).append((-r["v"], r["id"]))
    assert {(r["k"], r["rank"], r["id"]) for r in got.collect()} == {(k, i, x[1]) for k, xs in want.items() for i, x in enumerate(sorted(xs)[:8], 1)}


def test_cross_pairs_are_exact_and_families_transitive(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 300)}"
    base = [[word() for _ in range(40)] for _ in range(6)]
    texts = []
    for i in range(60):
        t = list(base[i // 2 % 6])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(40)] = word()
        texts.append((i, " ".join(t)))
    texts += [(100, None), (101, "too short"), (102, "Same Words here as there too"), (103, "same  words HERE as there too")]
    df = spark.createDataFrame(texts, "id int, text string")
    side = lambda i: i % 2 == 0
    got = similarity.cross_exact(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 0.5)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, (t or "").lower().split()) for i, t in texts)}
    want = {}
    for a in sets:
        for b in sets:
            if side(a) and not side(b) and sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= 0.5:
                    want[a, b] = j
    rows = {(r["a"], r["b"]): r["jaccard"] for r in got.collect()}
    assert set(rows) == set(want) and len(want) > 20 and all(math.isclose(rows[p], want[p]) for p in want) and rows[102, 103] == 1.0
    pairs = spark.createDataFrame([("d1", "t1", 0.85), ("d1", "t2", 0.95), ("d2", "t2", 0.81)], "a string, b string, jaccard double")
    families = {r["threshold"]: r for r in similarity.cross_families(pairs, [0.8, 0.9, 0.99]).collect()}
    assert (families[0.8]["families"], families[0.8]["largest"], families[0.9]["largest"], families[0.99]["families"], families[0.99]["pairs"]) == (1, 4, 2, 0, 0)


def copies_of(n):
    """Documents of five texts, two of them near copies, each n times on either side."""
    rng = random.Random(8)
    texts = [[f"w{rng.randint(0, 10**6)}" for _ in range(60)] for _ in range(4)]
    texts.append([*texts[0][:50], *texts[1][:10]])
    return [(i, " ".join(texts[i % 5])) for i in range(10 * n)]


def test_copies_are_classes_and_are_not_paired_up(spark, monkeypatch):
    docs = copies_of(40)
    df = spark.createDataFrame(docs, "id long, text string")
    sides = lambda: (df.where("id < 200"), df.where("id >= 200"))
    made = {}

    def record(df, tag):
        out = materialize(df, tag)
        made.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(similarity, "materialize", record)
    row = {r["threshold"]: r for r in similarity.cross_families(similarity.weighted_pairs(*similarity.cross_classes(*sides(), 0.5)), [0.5, 0.9]).collect()}
    assert [tuple(row[t])[1:] for t in (0.5, 0.9)] == [(40 * 40 * 7, 200, 200, 4, 400, 160), (40 * 40 * 5, 200, 200, 5, 400, 80)]
    # a text's hashes were rows for each of its copies, and their pairs for each two copies
    assert all(n <= 400 for counts in made.values() for n in counts)
    best = [tuple(r) for r in similarity.cross_best(*sides(), 0.5, 8).collect()]
    assert sorted((a, b, j, k) for a, b, j, k in best) == [(a, 200 + a % 5 + 5 * k, 1.0, k + 1) for a in range(200) for k in range(8)]
    some = df.where("id >= 200 and id < 203 or id >= 395 and id < 400")
    pairs = {(r["a"], r["b"]): r["jaccard"] for r in similarity.cross_exact(df.where("id < 10"), some, 0.5).collect()}
    mixed = [tuple(r) for r in similarity.cross_best(df.where("id < 10"), some, 0.5, 2).collect()]
    want = [(a, b, j, k) for a in range(10) for k, (j, b) in enumerate(sorted((-j, b) for (x, b), j in pairs.items() if x == a)[:2], 1)]
    assert sorted(mixed) == sorted((a, b, -j, k) for a, b, j, k in want) and pairs[0, 399] == pairs[4, 200] and 0.5 <= pairs[0, 399] < 0.9


def test_hashes_with_the_same_sets_meet_once(spark):
    own = similarity.hashed_sets(spark.createDataFrame(copies_of(1)[:5], "id long, text string"), "id")
    own = own.select("id", F.lit(similarity.BOTH).alias("kind"), F.col("s").alias("shingles"))
    first = similarity._prefixes(own, 0.5)
    # texts 0 and 4 share many hashes of their prefixes, which made as many rows of the same pair
    assert first.where("id in (0, 4)").count() > 4 and similarity._unlike(first).count() == 2
    assert [(r["a"], r["b"]) for r in similarity.set_pairs(own, 0.5).collect()] == [(0, 4)]


def test_band_keys_are_made_in_small_pieces():
    shingles = np.random.default_rng(3).integers(0, 1 << 64, size=5000, dtype=np.uint64)
    maps = near._maps(near.BANDS * near.ROWS)
    tracemalloc.start()
    keys = near.band_keys(shingles, maps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # values of a thousand shingles at once were 1.2 MB, twice, and left the cache
    assert peak < 600_000
    low = [(shingles * x + y).min() for x, y in zip(*maps, strict=True)]
    want = np.arange(1, near.BANDS + 1, dtype=np.uint64)
    for k in range(near.ROWS):
        want = (want ^ np.array(low[k :: near.ROWS], np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        want ^= want >> np.uint64(29)
    assert (keys == want.view(np.int64)).all()


def lists(spark):
    return spark.createDataFrame([("c", [1, 2], [0.5, 1.5]), ("a", [], []), ("b", [7], [2.5]), ("d", None, None)], "name string, x array<int>, y array<double>")


def test_ragged_round_trip_and_blocks(spark, monkeypatch):
    flat, offsets = ragged.flatten(lists(spark), "name", ["x", "y"])
    assert [tuple(r) for r in flat.orderBy("pos").collect()] == [(0, 7, 2.5), (1, 1, 0.5), (2, 2, 1.5)]
    assert [tuple(r) for r in offsets.orderBy("doc").collect()] == [(0, "a", 0, 0), (1, "b", 0, 1), (2, "c", 1, 3), (3, "d", 3, 3)]
    monkeypatch.setattr(ragged, "BLOCK", 2)
    back = {r["ident"]: (r["x"], r["y"]) for r in ragged.restore(flat, offsets).collect()}
    assert back == {"a": ([], []), "b": ([7], [2.5]), "c": ([1, 2], [0.5, 1.5]), "d": ([], [])}
    none = ragged.flatten(lists(spark).limit(0), "name", ["x", "y"])
    assert ragged.restore(*none).collect() == []


def test_broken_offsets_are_refused(spark):
    flat, offsets = (x.cache() for x in ragged.flatten(lists(spark), "name", ["x", "y"]))
    bent = lambda c, v: offsets.withColumn(c, F.expr(v))
    for values, offs in [
        (flat, bent("high", "if(doc = 1, null, high)")), (flat, bent("doc", "if(doc = 3, 4, doc)")), (flat, bent("doc", "if(doc = 3, 2, doc)")), (flat, bent("low", "if(doc = 2, 2, low)")),
        (flat, bent("high", "if(doc = 2, 0, high)")), (flat, bent("low", "low + 1").withColumn("high", F.col("high") + 1)), (flat.where("pos < 2"), offsets), (flat.where("pos > 0"), offsets), (flat.unionByName(flat.where("pos = 1")), offsets), (flat, offsets.where("doc < 2")),
    ]:
        with pytest.raises(ArtifactError):
            ragged.restore(values, offs)
    with pytest.raises(ArtifactError):
        ragged.flatten(lists(spark).withColumn("x", F.array(F.lit(1))), "name", ["x", "y"])
    with pytest.raises(ArtifactError):
        ragged.flatten(lists(spark).withColumn("name", F.lit("same")), "name", ["x", "y"])


def test_decoding_runs_from_a_ragged_table(spark):
    own = spans.lattices(spark, DATA).where("doc_id % 1000 < 3")
    flat, offsets = ragged.flatten(own, "doc_id", ["a", "b", "energies"])
    back = ragged.restore(flat, offsets).withColumnRenamed("ident", "doc_id").join(own.select("doc_id", "n", "k"), "doc_id")

    def kernel(row):
        return [{"doc_id": row["doc_id"], "mbr": str(decode.slot_mbr(spans._lattice(row), int(row["k"])).mbr)}]

    got, want = ({r["doc_id"]: r["mbr"] for r in decode.per_document(x, kernel, "doc_id long, mbr string").collect()} for x in (back, own))
    assert got == want and len(want) > 20


def test_ragged_tables_order_lengths_and_not_the_arrays(spark, monkeypatch):
    seen, total = [], ragged.running_total
    monkeypatch.setattr(ragged, "running_total", lambda df, *rest: seen.append(df) or total(df, *rest))
    flat, offsets = ragged.flatten(lists(spark), "name", ["x", "y"])
    assert [f.dataType.typeName() for df in seen for f in df.schema if f.dataType.typeName() == "array"] == []
    assert sum(r["high"] - r["low"] for r in offsets.collect()) == flat.count()
    # one place twice and one left out: as many places as values, within the same bounds
    wrong = flat.withColumn("pos", F.when(F.col("pos") == 1, 2).otherwise(F.col("pos")).cast("long"))
    with pytest.raises(ragged.ArtifactError):
        ragged.validate(wrong, offsets)
