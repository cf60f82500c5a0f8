"""Interval heads and Newton probes against plain NumPy: samples, derivatives, ranking, fits in groups and folds."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import decode as D, newton, sequence, spanhead as H
from quillspan.plans import models
from quillspan.schemas import TAGS
from tests.conftest import DATA

RNG = np.random.default_rng(12)


def test_samples_stand_for_the_population():
    gold, wide, old = [(3, 5, 1), (20, 21, 0)], [(30, 48)], [(7, 9), (31, 33), (3, 5)]
    plan = H.sample(60, gold, wide, old, key=5)
    every = D.universe(60)
    free = [(a, b) for a, b in every.tolist() if (b <= 30 or a >= 48)]
    assert plan.population == len(free) and math.isclose(plan.weight.sum(), plan.population)
    got = {(a, b): (y, k, w) for a, b, y, k, w in zip(plan.a.tolist(), plan.b.tolist(), plan.y.tolist(), plan.kind.tolist(), plan.weight.tolist(), strict=True)}
    assert got[3, 5] == (2, H.POSITIVE, 1.0) and got[7, 9][1] == H.OLD and (31, 33) not in got and got[3, 6][1] == H.NEAR
    assert all(p in set(free) for p in got) and sum(k == H.DRAWN for _, k, _ in got.values()) == 256
    # each seed draws others, and weighted sums come out right on average
    value = np.sin(every[:, 0] * 3.1 + every[:, 1])
    place = {tuple(p): i for i, p in enumerate(every.tolist())}
    want = sum(value[place[p]] for p in free)
    sums = []
    for seed in range(300):
        p = H.sample(60, gold, wide, old, key=5, seed=seed)
        sums.append(sum(w * value[place[a, b]] for a, b, w in zip(p.a.tolist(), p.b.tolist(), p.weight.tolist(), strict=True)))
    assert abs(np.mean(sums) - want) < 4 * np.std(sums) / math.sqrt(300) + 1e-9 and np.std(sums) > 1
    with pytest.raises(ValueError):
        H.sample(5, [(0, 1, 0), (0, 1, 1)], [], [], 1)
    few = H.sample(2, [], [], [], 1)
    assert few.population == 3 == len(few.a) and H.sample(0, [], [], [], 1).population == 0


def small(n=6, slots=8, width=3):
    return RNG.integers(-1, slots, size=(n, width)), RNG.normal(size=H.Head.size(slots)) * 0.4


def test_entropy_slope_equals_finite_differences():
    table, x = small()
    plan = H.sample(6, [(1, 3, 2)], [], [], 3, size=4)

    def loss(at):
        return H.entropy_part(H.Head(at, 8), table, plan)[0]

    _, slope = H.entropy_part(H.Head(x, 8), table, plan)
    first = np.zeros((9, H.CLASSES))
    for r, a in zip(slope, plan.a, strict=True):
        for s in table[a]:
            first[s] += r
    for at in [0, 9, 40, 63]:
        step = np.zeros_like(x)
        step[at] = 1e-5
        assert math.isclose((loss(x + step) - loss(x - step)) / 2e-5, first[:-1].ravel()[at], abs_tol=1e-6)


def test_ranking_meets_the_strongest_rival_of_all():
    for _ in range(20):
        table, x = small()
        head = H.Head(x, 8)
        gold = [(0, 2, int(RNG.integers(7))), (3, 4, 1)]
        lattice = head.lattice(table)
        energy = lambda s: sum(lattice.energies[D.interval_place(a, b), y] for a, b, y in s)  # noqa: B023, E731
        pairs = D.universe(6).tolist()
        rivals = [((*p, y), (*q, z)) for p, q in itertools.combinations(pairs, 2) for y in range(7) for z in range(7) if p[1] <= q[0] or q[1] <= p[0]]
        best = max(energy(sorted(s)) for s in rivals if sorted(s) != gold)
        loss, by, rival, own = H.ranking_part(head, table, gold)
        gap = (best - energy(gold)) / 2
        assert math.isclose(loss, math.log1p(math.exp(gap)), rel_tol=1e-9) and math.isclose(energy(rival), best, abs_tol=1e-9) and rival != gold == own
        assert math.isclose(by, 1 / (1 + math.exp(-gap)) / 2)
    assert H.ranking_part(head, table, []) is None


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(1, "Anna went to Berlin today . " * 60, None), (2, "the cat", None), (3, "Carl saw Rome", None), (4, "", None)]
    gold = [(1, i * 28 + a, i * 28 + b, x) for i in range(60) for a, b, x in ((0, 4, "NAME"), (13, 25, "ADDRESS"))] + [(3, 0, 4, "NAME"), (3, 10, 12, "DATE")]
    tagged = sequence.training_rows(spark.createDataFrame(texts, "doc_id long, text string, extra string"), spark.createDataFrame(gold, "doc_id long, start int, end int, label string"), TAGS, bits=6)
    return H.stretches(tagged, spark.createDataFrame([(1, 5, 9), (3, 5, 8)], "doc_id long, start int, end int"))


def test_stretches_hold_every_token_once_and_cut_no_gold(rows):
    got = {(r["doc_id"], r["part"]): r for r in rows.collect()}
    assert [got[1, p]["n"] for p in range(2)] == [255, 105] and got[2, 0]["n"] == 2
    golds = [np.array(got[1, p]["gold"]).reshape(-1, 3) for p in range(2)]
    assert sum(map(len, golds)) == 120 and all((g[:, 1] <= n).all() for g, n in zip(golds, (255, 105), strict=True))
    # the gold that ends within a token is protected: the token it touches
    assert got[3, 0]["protected"] == [2, 3] and got[3, 0]["old"] == [1, 2] and got[3, 0]["gold"] == [0, 1, 0]
    assert H.cuts(10, [(3, 6)], 4) == [0, 3, 7, 10] and H.cuts(0, [], 4) == [0]


def test_evaluation_is_the_same_for_any_partitioning_and_by_differences(rows):
    x = RNG.normal(size=H.Head.size(64)) * 0.1
    made = [H.evaluation(rows.repartition(n), 64, ranking=0.7, l2=0.01) for n in (1, 3)]
    (loss, slope), (again, same) = made[0](x), made[1](x)
    assert math.isclose(loss, again, rel_tol=1e-12) and np.allclose(slope, same, atol=1e-12)
    for at in [*np.argsort(-np.abs(slope))[:4].tolist(), len(x) - 3]:
        step = np.zeros_like(x)
        step[at] = 1e-6
        assert math.isclose((made[0](x + step)[0] - made[0](x - step)[0]) / 2e-6, slope[at], abs_tol=1e-5)


def test_training_falls_and_ranking_widens_the_gap(rows):
    x, log = H.train(rows, 6, rounds=12)
    assert log[-1].loss < 0.3 * log[0].loss and all(a.loss >= b.loss for a, b in zip(log, log[1:], strict=False))
    y, ranked = H.train(rows, 6, rounds=12, ranking=1.0, start=x)
    assert all(a.loss >= b.loss for a, b in zip(ranked, ranked[1:], strict=False))
    gap = [H.records(rows, w, 6).agg(F.avg("gap"), F.sum("right"), F.sum("k")).first() for w in (x, y)]
    assert gap[1][0] > gap[0][0] and gap[1][1] >= gap[0][1] and gap[0][2] == 121


def test_registered_heads(spark):
    got = models.span_head(spark, DATA).agg(F.sum("right"), F.sum("k")).first()
    assert got[0] > 0.7 * got[1] > 0
    arms = {r["arm"]: r for r in models.global_ranking(spark, DATA).collect()}
    assert arms["challenger"]["wins"] >= arms["control"]["wins"] and arms["challenger"]["mean_gap"] > arms["control"]["mean_gap"]


# ---------------------------------------------------------------- probes


def plain_probe(x, y, w, strength=newton.STRENGTH):
    """Gradient descent's fixed point by many plain Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    design = np.column_stack([np.ones(len(x)), (x - mean) / np.where(scale < 1e-12, 1, scale)])
    beta, charge = np.zeros(design.shape[1]), np.array([0.0] + [strength] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        beta = beta - np.linalg.solve((design.T * (w * p * (1 - p) / w.sum())) @ design + np.diag(charge), design.T @ (w * (p - y)) / w.sum() + charge * beta)
    return 1 / (1 + np.exp(-design @ beta)), beta


def probe_rows(n=400):
    out = []
    for i in range(n):
        x0, x1, g, f = RNG.normal() * 50 + 900, float(RNG.integers(0, 3)), "ab"[i % 2], i % 3
        y = int(RNG.random() < 1 / (1 + math.exp(-(x0 - 900) / 40 - x1 + 1)))
        out.append((i, g, f, x0, x1, 7.0, y, float(RNG.integers(0, 4))))
    return out


SCHEMA = "id int, g string, fold int, x0 double, x1 double, flat double, y int, w double"


def test_probes_equal_a_plain_fit_for_each_group(spark):
    made = probe_rows()
    df = spark.createDataFrame([*made, (900, "one", 0, 1.0, 1.0, 7.0, 1, 1.0), (901, "a", 0, None, 1.0, 7.0, 1, 1.0), (902, None, 1, 1.0, 1.0, 7.0, 0, 1.0)], SCHEMA).repartition(4)
    for weight in (None, "w"):
        probes = newton.fit(df, ["x0", "x1", "flat"], weight=weight, by=["g"])
        assert set(probes) == {("a",), ("b",)} and all(p.done and p.steepness <= 1e-8 and p.steps < 20 for p in probes.values())
        got = {r["id"]: r["score"] for r in newton.score(df, probes, ["x0", "x1", "flat"], ["g"]).collect()}
        assert got[900] is got[901] is got[902] is None and len(got) == len(made) + 3
        for g in "ab":
            own = [r for r in made if r[1] == g]
            want, beta = plain_probe(np.array([r[3:6] for r in own]), np.array([r[6] for r in own]), np.array([r[7] if weight else 1.0 for r in own]))
            assert np.allclose([got[r[0]] for r in own], want, atol=1e-7) and np.allclose(probes[g,].beta, beta, atol=1e-6)
    whole = newton.fit(df, ["x0"])
    assert set(whole) == {()} and newton.score(df, whole, ["x0"]).where("score is null").count() == 1
    with pytest.raises(ValueError):
        newton.fit(df.withColumn("y", F.lit(2)), ["x0"])
    with pytest.raises(ValueError):
        newton.fit(df.withColumn("w", -F.col("w") - 1), ["x0"], weight="w")
    assert newton.fit(df.limit(0), ["x0"]) == {} and newton.score(df.limit(0), {}, ["x0"], ["g"]).count() == 0


def test_out_of_fold_scores_come_from_the_other_folds(spark):
    made = probe_rows(300)
    got = {r["id"]: r["score"] for r in newton.out_of_fold(spark.createDataFrame(made, SCHEMA), "fold", 3, ["x0", "x1"], by=["g"]).collect()}
    for g, f in itertools.product("ab", range(3)):
        fit = [r for r in made if r[1] == g and r[2] != f]
        x, y = np.array([r[3:5] for r in fit]), np.array([r[6] for r in fit])
        _, beta = plain_probe(x, y, np.ones(len(y)))
        for r in made:
            if r[1] == g and r[2] == f:
                z = beta[0] + beta[1:] @ ((np.array(r[3:5]) - x.mean(axis=0)) / x.std(axis=0))
                assert math.isclose(got[r[0]], 1 / (1 + math.exp(-z)), abs_tol=1e-7)


def test_registered_probes(spark):
    rows = models.newton_probe(spark, DATA).groupBy("variant").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("one"), F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("zero")).collect()
    assert {r["variant"] for r in rows} == set(models.VARIANTS) and len({r["n"] for r in rows}) == 1
    assert all(r["scored"] > 0 and r["one"] > r["zero"] for r in rows if r["variant"] == "all")


def test_plans_are_drawn_once_and_serve_every_evaluation(rows):
    packed = H.blocks(rows)
    n = rows.agg({"n": "sum"}).first()[0]
    assert sum(len(np.frombuffer(r["sizes"], np.int32)) for r in packed.collect()) == rows.count()
    assert sum(int(np.frombuffer(r["sizes"], np.int32).sum()) for r in packed.collect()) == n
    x = np.random.default_rng(5).normal(size=H.Head.size(64)) * 0.1
    (a, p), (b, q) = (H.evaluation(r, 64, ranking=0.7)(x) for r in (packed, rows))
    assert np.isclose(a, b, rtol=1e-12) and np.allclose(p, q, atol=1e-10)
    # with no weights every class is as likely, for every interval that may be drawn
    assert np.isclose(H.evaluation(packed, 64)(np.zeros_like(x))[0], np.log(H.CLASSES))


def test_intervals_with_new_energies_share_their_order():
    blank = H._all_intervals(20)
    energies = np.random.default_rng(6).normal(size=blank.energies.shape)
    made = blank.priced(energies)
    assert made.left is blank.left and (blank.energies == 0).all()
    assert H.decode.best_two(made, 3) == H.decode.best_two(H.decode.Lattice(20, blank.pairs, energies), 3)
    with pytest.raises(ValueError):
        blank.priced(np.where(energies > 0, np.nan, energies))
