"""Fixed examples for text, reassembly, evaluation, splits, similarity, artifacts."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillspan.functions.text import masked, normalized, shape, shingles, words
from quillspan.operators import annotations, audit, calibration, candidates, evaluation, features, reassembly, similarity, splitting, stats
from quillspan.operators.components import connected_components
from quillspan.operators.prefix import running_total
from quillspan.schemas import LABELS, SEGMENTS
from quillspan.sources import artifacts, tabular

SPAN = "doc_id long, start int, end int, label string"


def spans(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], SPAN)


def test_reassembly_of_shuffled_unicode(spark):
    rows = spark.createDataFrame([(1, 2, "é😀"), (1, 0, "A"), (1, 1, ""), (2, 0, "x"), (2, 2, "y"), (3, 0, None)], "doc_id long, segment_index int, text string")
    out = {r["doc_id"]: r for r in reassembly.reassemble(rows).collect()}
    r = out[1]
    assert (r["full_text"], r["n_chars"], r["n_segments"], r["n_words"], r["n_nonempty_segments"], r["contiguous"]) == ("A\n\né😀", 5, 3, 2, 2, True)
    assert not out[2]["contiguous"] and out[3]["full_text"] == ""


def test_text_functions(spark):
    df = spark.createDataFrame([(" Hello\t WORLD 12 345 ",)], "t string")
    r = df.select(normalized(F.col("t")).alias("n"), masked(F.col("t")).alias("m"), F.size(words(F.col("t"))).alias("w"), shape(F.lit("Ab12-C")).alias("s"), shingles(F.lit("a B c d e f")).alias("g"), shingles(F.lit("a b")).alias("e")).first()
    assert r["n"] == "hello world 12 345" and r["m"] == "hello world 0 0" and r["w"] == 4 and r["s"] == "Xxd-X"
    assert r["g"] == ["a b c d e", "b c d e f"] and r["e"] == []


def test_slot_shift_and_error_kinds(spark):
    gold = spans(spark, [(0, 1, "NAME"), (2, 3, "DATE"), (4, 5, "EMAIL")])
    pred = spans(spark, [(2, 3, "DATE"), (4, 5, "EMAIL")])
    assert evaluation.slot_accuracy(gold, pred).first()["slot_accuracy"] == 0
    r = evaluation.entity_prf(gold, pred, evaluation.SPAN).first()
    assert r["precision"] == 1 and math.isclose(r["recall"], 2 / 3)
    assert evaluation.error_taxonomy(gold, pred, pred).where("output_category = 'exact_span_wrong_slot'").count() == 2
    gold, pred = spans(spark, [(0, 2, "NAME"), (3, 6, "ADDRESS")]), spans(spark, [(0, 2, "USERNAME"), (3, 5, "ADDRESS")])
    assert {r["relation"] for r in evaluation.relations(gold, pred).collect()} == {"same_boundary_wrong_label", "overlap_same_label"}
    assert evaluation.entity_prf(gold, pred, ["doc_id", "start", "end"]).first()["f1"] == 0.5


def test_displacement(spark):
    gold = spans(spark, [(2, 3, "A"), (4, 5, "B"), (6, 7, "C")])
    pred = spans(spark, [(0, 1, "X"), (2, 3, "A"), (4, 5, "B")])
    e = evaluation.episodes(gold, pred).collect()
    assert len(e) == 1 and e[0]["simple"] and e[0]["length"] == 2
    assert evaluation.episode_outcomes(gold, pred, gold).first()["outcome"] == "REPAIRED"
    assert all(r["cumulative"] == r["displacement"] for r in evaluation.gaps(gold, pred).collect())
    assert sum(r["n"] for r in evaluation.transitions(gold, pred, gold).collect()) == 3


def test_submission_faults(spark):
    docs = spark.createDataFrame([("d", 10, 2)], "doc_id string, n_chars int, expected int")
    good = spark.createDataFrame([("d_01", "NAME:0:5"), ("d_02", "DATE:6:10")], "row_id string, Predicted string")
    assert evaluation.submission_faults(good, docs, LABELS).isEmpty()
    bad = spark.createDataFrame([("d_01", "NAME:0:7"), ("d_02", "WHAT:6:11"), ("d_03", "x"), ("e_01", "NAME:0:1")], "row_id string, Predicted string")
    assert {r["fault"] for r in evaluation.submission_faults(bad, docs, LABELS).collect()} == {"overlap", "label", "bounds", "format", "unknown_document", "count"}


def test_dictionary_and_contexts(spark):
    docs = spark.createDataFrame([(1, "Alice Alice, Malice. username is 'rjohnson_prime'.")], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 0, 5, "NAME", "Alice")], SPAN + ", value string")
    r = candidates.fit_dictionary(docs, gold).first()
    assert (r["occurrences"], r["score"], r["label"]) == (2, 0.5, "NAME")
    u = candidates.username_hits(docs).first()
    assert docs.first()["text"][u["start"] : u["end"]] == "rjohnson_prime"
    phrases = docs.select(F.explode(F.array(F.lit("Alice"), F.lit("is 'rjohnson"), F.lit("Alice Alice, Malice. username is 'rj"))).alias("phrase"))
    a, b = candidates.dictionary_hits(docs, phrases), candidates.dictionary_join(docs, phrases)
    assert audit.same_rows(a.select(sorted(a.columns)), b.select(sorted(a.columns)))


def test_splits_keep_groups_and_do_not_depend_on_order(spark):
    rows = [(f"d{i:03d}", f"g{i // 2:03d}", "s1" if i < 40 else "s2", "train" if i == 0 else "reviewed" if i == 41 else None) for i in range(60)]
    schema = "document_id string, duplicate_group string, stratum string, fixed string"
    one = {r["document_id"]: r["partition"] for r in splitting.assign_splits(spark.createDataFrame(rows, schema), 1).collect()}
    two = {r["document_id"]: r["partition"] for r in splitting.assign_splits(spark.createDataFrame(rows[::-1], schema), 1).collect()}
    assert one == two and one["d000"] == one["d001"] == "train" and one["d040"] == one["d041"] == "dev"
    assert all(one[f"d{i:03d}"] == one[f"d{i + 1:03d}"] for i in range(0, 60, 2)) and "holdout" in one.values()
    with pytest.raises(ValueError):
        splitting.assign_splits(spark.createDataFrame([("a", "g", "s", "train"), ("b", "g", "s", "dev")], schema), 1)


def test_running_total(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 100).alias("k"), F.lit(2).alias("v"))
    assert all(r["b"] == 2 * r["k"] for r in running_total(df, ["k"], {"b": "v"}).collect())


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3)], "a long, b long")
    out = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert len(out) == 44 and {out[i] for i in range(41)} == {0} and out[102] == 100
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_similarity(spark):
    letters = "abcdefghij"
    base = " ".join(a + b for a in letters for b in letters)
    docs = spark.createDataFrame([(1, base), (2, base.replace("jj", "z")), (3, base.upper() + "  "), (4, "short text"), (5, " ".join("x" + a + b for a in letters for b in letters))], "doc_id long, text string")
    reps = similarity.representatives(docs)
    exact = similarity.exact_pairs(reps).collect()
    assert [(r["a"], r["b"]) for r in exact] == [(1, 2)] and 0.8 <= exact[0]["jaccard"] < 1
    signed = similarity.with_signature(reps)
    assert similarity.lsh_pairs(signed, None, "doc_id").where("a = 1 and b = 2").count() == 1
    assert similarity.signature([]) is None
    fam = {r["doc_id"]: r["group_id"] for r in similarity.families(docs).collect()}
    assert fam[1] == fam[2] == fam[3] == 1 and fam[4] == 4 and fam[5] == 5


def test_statistics_on_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert calibration.weighted_auc(df, "p", "y").first()["auc"] == 0.875
    two = spark.createDataFrame([(1, 0.8, 3.0), (0, 0.25, 1.0)], "y int, p double, w double")
    assert math.isclose(calibration.weighted_logloss(two, "p", "y", F.col("w")).first()["logloss"], (3 * -math.log(0.8) - math.log(0.75)) / 4)
    pooled = spark.createDataFrame([(1, 1, 1), (2, 0, 9)], "d long, delta int, k int")
    assert math.isclose(calibration.bootstrap(pooled, "d", "delta", "k", 50, 1).first()["observed"], 0.1)
    assert stats.ks_statistic(df.withColumn("s", F.col("y") == 1), F.col("s"), "p").first()["statistic"] == 0.5
    assert stats.index_quantile(spark.range(20), "id", 0.95).first()["value"] == 19


def test_beta(spark):
    rows = [(1, [0], [1], [[0.0, 1.0]], 1, g) for g in (1.0, 1.0, 0.0)]
    schema = "n int, a array<int>, b array<int>, energies array<array<double>>, k int, gold_energy double"
    beta, bound = calibration.fit_beta(spark.createDataFrame(rows, schema))
    assert bound is None and math.isclose(beta, math.log(2), abs_tol=1e-4)
    assert calibration.fit_beta(spark.createDataFrame(rows[:2], schema))[1] == "upper"


def test_layout_and_titles():
    text = "Header: x\r\nline two\r\n\r\nBody\r\nlast"
    tokens = [(m.start(), m.end()) for m in __import__("re").finditer(r"\w+|[^\w\s]", text)]
    control, structure = features.layout(text, tokens, [(0, 2), (2, 3), (5, 6), (0, 7)])
    assert control.shape == (4, 21) and structure.shape == (4, 19)
    assert structure[:, 2].tolist() == [0, 0, 1, 0] and structure[:, 3].tolist() == [0, 0, 1, 1]  # paragraphs of both ends
    assert structure[1, 7] == 1.0 and structure[2, 4] == 1.0
    assert len(features.DENSE) == 52 and len(features.CATEGORIES) == 12 and len(features.NUMBERS) == 20
    assert annotations.adjust_titles("Dr. Smith", [(4, 9, "NAME")], "included") == [(0, 9, "NAME")]
    assert annotations.adjust_titles("Dr. Smith", [(0, 9, "NAME")], "excluded") == [(4, 9, "NAME")]


def test_csv_and_ids(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('document_id,segment_index,text\nd,0,"He said ""hi"", ok"\nd,1,\n', encoding="utf-8")
    rows = tabular.read_csv(spark, str(p), SEGMENTS).orderBy("segment_index").collect()
    assert [r["text"] for r in rows] == ['He said "hi", ok', ""]
    p.write_text("document_id,text,segment_index\n", encoding="utf-8")
    with pytest.raises(tabular.SchemaError):
        tabular.read_csv(spark, str(p), SEGMENTS)
    js = spark.createDataFrame([('{"a":[{"document_id":"x"},{"b":{"document_id" : "y\\"z"}}],"t":"\\"document_id\\": \\"no\\""}',)], "j string")
    assert {r["id"] for r in tabular.collect_ids(js, "j").collect()} == {"x", 'y"z'}


def test_artifacts(spark, tmp_path):
    gold = spark.createDataFrame([("d", "ab", [("NAME", 0, 2, "ab")], 1)], artifacts.GOLD)
    path = f"file://{tmp_path}/build"
    artifacts.publish(spark, {"train": gold, "holdout": gold}, path, keys={"train": "document_id"})
    assert artifacts.publish(spark, {"train": gold.limit(0)}, path)["files"]["train"]["rows"] == 1
    data = artifacts.PreparedData(spark, path)
    assert data.load("train", "fit").count() == 1
    for part, purpose in (("train", "predict"), ("holdout", "final_evaluation"), ("../x", "fit"), ("dev", "evaluate")):
        with pytest.raises(artifacts.ArtifactError):
            data.load(part, purpose)
    assert data.load("holdout", "final_evaluation", allow_final_evaluation=True).count() == 1
    gold.write.mode("append").parquet(f"{path}/train.parquet")
    with pytest.raises(artifacts.ArtifactError):
        data.load("train", "fit")
    with pytest.raises(artifacts.ArtifactError, match="cell"):
        artifacts.verify(gold, gold.withColumn("full_text", F.lit("x")))


def test_streamed_reassembly(spark, tmp_path):
    from quillspan.streaming.reassembly import segment_stream, upsert_batches

    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 1, "late")], "doc_id long, segment_index int, text string").withColumn("ts", F.current_timestamp())
    rows.write.parquet(f"{tmp_path}/in")
    q = upsert_batches(segment_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert [r["full_text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["a\nb"]


def test_families_and_membership_lose_no_document(spark):
    import random

    from quillspan.operators import similarity

    rng = random.Random(3)
    grams = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    while True:  # similar texts that share no band
        a = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(100)]
        b = a[:10] + ["zz"] + a[11:50] + ["yy"] + a[51:]
        s, t = similarity.signature(grams(a)), similarity.signature(grams(b))
        if all(s[i : i + 2] != t[i : i + 2] for i in range(0, 8, 2)):
            break
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(b).upper())], "doc_id long, text string")
    assert len(set(grams(a)) & set(grams(b))) >= 0.8 * len(set(grams(a)) | set(grams(b)))
    assert {(r[0], r[1]) for r in similarity.families(docs).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {(r[0], r[1]) for r in similarity.membership(docs).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_streamed_lines_of_one_document_meet_across_batches(spark, tmp_path):
    from quillspan.streaming.reassembly import segment_stream, upsert_batches

    def send(rows, name):
        spark.createDataFrame(rows, "doc_id long, segment_index int, text string").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upsert_batches(segment_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
        return {r["doc_id"]: r["full_text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert send([(1, 1, "b"), (1, 0, "a"), (2, 1, "late"), (None, 0, "x")], "one") == {1: "a\nb"}
    # a document grows, out of order and with a line that comes twice; the late first line of another arrives
    assert send([(1, 3, "d"), (1, 2, "c"), (1, 1, "b"), (2, 0, "first"), (3, 0, None)], "two") == {1: "a\nb\nc\nd", 2: "first\nlate", 3: ""}
    # a gap takes a document out, the missing line brings it back; a new text for an index replaces the old one
    assert send([(2, 3, "z"), (3, 0, "now")], "three") == {1: "a\nb\nc\nd", 3: "now"}
    assert send([(2, 2, "y")], "four") == {1: "a\nb\nc\nd", 2: "first\nlate\ny\nz", 3: "now"}


def test_windowed_documents(spark, tmp_path):
    import datetime as dt

    from quillspan.streaming.reassembly import segment_stream, windowed_documents

    at = dt.datetime(2026, 1, 1, 10, 30)
    rows = [(1, 1, "b", at), (1, 0, None, at), (2, 1, "q", at), (9, 0, "later", at + dt.timedelta(hours=5))]
    spark.createDataFrame(rows, "doc_id long, segment_index int, text string, ts timestamp").write.parquet(f"{tmp_path}/in")
    q = windowed_documents(segment_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("windowed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    got = {(r["doc_id"], r["full_text"], r["n_segments"], r["contiguous"]) for r in spark.table("windowed").collect()}
    assert got == {(1, "\nb", 2, True), (2, "q", 1, False)}


def test_folds_match_the_sequential_rule(spark):
    import hashlib
    import random

    rng = random.Random(2)
    for folds, sizes in ((3, [rng.choice([1, 1, 1, 2, 3, 50, 400]) for _ in range(300)]), (5, [7] * 40 + [1] * 90), (2, [0, 0, 3, 1]), (4, [])):
        rows = [(i, n) for i, n in enumerate(sizes)]
        load, want = [0] * folds, {}
        for i, n in sorted(rows, key=lambda r: (-r[1], hashlib.sha256(f"9:{r[0]}".encode()).hexdigest())):
            f = min(range(folds), key=lambda x: (load[x], x))
            load[f] += n
            want[i] = f
        out = splitting.greedy_folds(spark.createDataFrame(rows, "group_id long, size int").repartition(3), folds, 9).collect()
        assert {r["group_id"]: r["fold"] for r in out} == want and {r["group_id"]: r["size"] for r in out} == dict(rows)


def test_quantiles_of_odd_groups(spark):
    import numpy as np

    rows = [("a", float(x), 1.0) for x in (5, 1, 1, 9, 2)] + [("b", 3.0, None), (None, 4.0, 2.0), (None, 8.0, None)]
    out = {(r["group"], r["field"]): r for r in stats.quantile_profile(spark.createDataFrame(rows, "g string, x double, y double"), ["x", "y"], "g").collect()}
    assert set(out) == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), (None, "x"), (None, "y")}
    for q in stats.QUANTILES:
        name = f"q{int(q * 100):03d}"
        assert math.isclose(out["a", "x"][name], np.quantile([5, 1, 1, 9, 2], q)) and math.isclose(out[None, "x"][name], np.quantile([4, 8], q)) and out["b", "y"][name] is None


def test_phrases_longer_than_the_runs_they_meet_on(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i jk. Ab-cd"), (2, "xa b c d e f"), (3, None)], "doc_id long, text string")
    phrases = spark.createDataFrame([("a b c d e f g",), ("a b c d e f g h i j",), ("b c",), ("-",), ("Ab-cd",), ("",)], "phrase string")
    a, b = candidates.dictionary_hits(docs, phrases), candidates.dictionary_join(docs, phrases, runs=3)
    got = sorted(map(tuple, a.collect()))
    assert got == sorted(map(tuple, b.select("doc_id", "start", "end", "phrase").collect()))
    assert got == [(1, 0, 13, "a b c d e f g"), (1, 2, 5, "b c"), (1, 22, 27, "Ab-cd"), (1, 24, 25, "-"), (2, 3, 6, "b c")]


def test_bootstrap_agrees_with_resampling(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, int(d), int(k)) for i, (d, k) in enumerate(zip(rng.integers(-3, 4, 400), rng.integers(1, 9, 400), strict=True))]
    out = calibration.bootstrap(spark.createDataFrame(rows, "d long, delta int, k int").repartition(3), "d", "delta", "k", 4000, 5).first()
    x = np.array(rows)[:, 1:]
    draws = rng.integers(0, len(x), (4000, len(x)))
    ratio = x[draws, 0].sum(axis=1) / x[draws, 1].sum(axis=1)
    low, mid, high = np.quantile(ratio, [0.025, 0.5, 0.975])
    assert abs(out["low"] - low) < 0.006 and abs(out["median"] - mid) < 0.006 and abs(out["high"] - high) < 0.006


def test_readers_and_sinks(spark, tmp_path):
    from pyspark.errors import PySparkException
    from pyspark.sql import types as T

    p = tmp_path / "loose.csv"
    p.write_text('﻿"id",text\n1,"a ""b"", c"\n2,\n', encoding="utf-8")
    loose = tabular.read_csv_loose(spark, str(p))
    assert loose.columns == ["id", "text"] and [tuple(r) for r in loose.orderBy("id").collect()] == [("1", 'a "b", c'), ("2", None)]
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1, "b": "x"}\n{"b": "ü\\n", "c": [1]}\n', encoding="utf-8")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert sorted((r["a"] or 0, r["b"]) for r in tabular.read_jsonl(spark, str(lines), schema).collect()) == [(0, "ü\n"), (1, "x")]
    lines.write_text('{"a": 1}\n{broken\n', encoding="utf-8")
    with pytest.raises(Exception, match="Malformed|FAILFAST|malformed"):
        tabular.read_jsonl(spark, str(lines), schema).collect()
    assert tabular.read_jsonl(spark, str(lines), schema, strict=False).where("a = 1").count() == 1
    array = tmp_path / "x.json"
    array.write_text('[{"document_id": "d1", "group_id": "g", "text": "{\\"document_id\\": 3}"}, {"document_id": "d2", "deep": {"document_id": "no"}}]', encoding="utf-8")
    assert sorted((r["document_id"], r["group_id"]) for r in tabular.read_identities(spark, str(array)).collect()) == [("d1", "g"), ("d2", None)]
    df = spark.createDataFrame([(2, "b,\"q\""), (1, "a"), (3, "c")], "n int, v string")
    tabular.write_csv_ordered(df, f"{tmp_path}/sub", "n")
    files = list((tmp_path / "sub").glob("part-*.csv"))
    assert len(files) == 1 and files[0].read_text(encoding="utf-8") == 'v\na\n"b,""q"""\nc\n'
    tabular.write_parquet(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    with pytest.raises(PySparkException):
        tabular.write_parquet(df, f"{tmp_path}/out")


def test_scratch_tables_are_discarded_and_need_a_shared_folder(spark, monkeypatch):
    import os

    from quillspan.sources import scratch

    df = scratch.materialize(spark.range(3), "t")
    path = df.scratch_path.removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path) and df.count() == 3
    scratch.discard(df)
    assert not os.path.exists(path)

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_folder(Session())


def test_hashes_replays_and_stages(spark, tmp_path):
    import hashlib

    from quillspan.operators import replay
    from quillspan.sources import artifacts

    kind = "doc_id string, predicted array<struct<start: int, end: int, label: string>>"
    rows = [("é", [(0, 2, "NAME"), (2, 5, "DATE")]), ("b", [])]
    df = spark.createDataFrame(rows, kind)
    assert replay.canonical_hash(df) == hashlib.sha256('[["b",[]],["é",[[0,2,"NAME"],[2,5,"DATE"]]]]'.encode()).hexdigest()
    assert replay.canonical_hash(df.limit(0)) == hashlib.sha256(b"[]").hexdigest()
    for bad in ([(2, 5, "DATE"), (0, 2, "NAME")], [(0, 3, "NAME"), (2, 5, "DATE")], [(3, 3, "NAME")], [(0, 1, "OTHER")], [(0, 1, "NAME"), (0, 1, "NAME")]):
        with pytest.raises(ValueError):
            replay.canonical_hash(spark.createDataFrame([("a", bad)], kind))
    with pytest.raises(ValueError):
        replay.canonical_hash(df.union(df))
    a, b = spans(spark, [(0, 1, "NAME"), (2, 3, "DATE")]), spans(spark, [(0, 1, "NAME"), (2, 3, "EMAIL")])
    assert tuple(replay.replay(a, a).first()) == (1, 1, 0, 0) and tuple(replay.replay(a, b).first()) == (1, 0, 1, 1)
    made = []

    def first(_):
        made.append("first")
        return spark.range(4).toDF("x")

    def second(done):
        made.append("second")
        return spark.read.parquet(done["first"]).where("x > 1")

    root = f"file://{tmp_path}/stages"
    paths = replay.Stages(spark, root, [("first", first), ("second", second)]).run()
    assert spark.read.parquet(paths["second"]).count() == 2
    assert replay.Stages(spark, root, [("first", first), ("second", second)]).run() == paths and made == ["first", "second"]
    spark.range(1).toDF("x").write.mode("append").parquet(paths["first"])
    with pytest.raises(artifacts.ArtifactError):
        replay.Stages(spark, root, [("first", first), ("second", second)]).run()


def test_scores_become_spans(spark):
    from quillspan.operators import replay

    labels = [[0.0] * 8 for _ in range(3)]
    labels[0][1], labels[1][3], labels[2][2] = 5.0, 4.0, 1.0  # intervals [0, 1), [1, 2), [0, 2)
    rows = [(7, 2, [0, 1, 0], [1, 2, 2], labels, 2, [(3, 6), (7, 9)])]
    df = spark.createDataFrame(rows, "doc_id long, n int, a array<int>, b array<int>, logits array<array<double>>, k int, bounds array<struct<start: int, end: int>>")
    assert [tuple(r) for r in replay.decode_scores(df).collect()] == [(7, 1, 3, 6, "NAME"), (7, 2, 7, 9, "EMAIL")]


def test_models_are_read_as_written(spark, tmp_path):
    from quillspan.operators import scoring
    from quillspan.sources import artifacts

    df = spark.range(40).select((F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 4 > 1).cast("int").alias("y"))
    model = scoring.linear_probe(df, ["x"])
    path = f"file://{tmp_path}/model"
    digest = scoring.save_model(model, path)
    again = scoring.load_model(path, digest)
    assert scoring.probability(again, df).orderBy("x").collect() == scoring.probability(model, df).orderBy("x").collect()
    with pytest.raises(artifacts.ArtifactError):
        scoring.load_model(path, "0" * 64)


def test_samples_keep_families_whole(spark):
    import random

    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=30)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i].upper()) for i in range(10)] + [(200 + i, texts[i]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = similarity.group_and_sample(docs, 20, 40, 3, 2, 5).collect()
    assert 20 <= len(out) <= 40
    groups = {r["group_id"]: set() for r in out}
    for r in out:
        groups[r["group_id"]].add((r["doc_id"], r["fold"]))
    for g, members in groups.items():
        assert {d for d, _ in members} == {g} | ({100 + g} if g < 10 else set()) | ({200 + g} if g < 5 else set()) and len({f for _, f in members}) == 1
    for size, most, least in ((20, 5, 2), (20, 40, 30)):
        with pytest.raises(ValueError):
            similarity.group_and_sample(docs, size, most, 3, least, 5)


def test_tree_hash_follows_every_span_and_no_partitioning(spark, monkeypatch):
    import hashlib

    from quillspan.operators import replay

    monkeypatch.setattr(replay, "FAN", 3)
    schema = "doc_id string, predicted array<struct<start:int,end:int,label:string>>"
    rows = [(f"d{i:02d}", [(0, 2, "NAME"), (2, 5, "DATE")][: i % 3]) for i in range(20)]
    made = spark.createDataFrame(rows, schema)
    got = [tuple(replay.tree_hash(made.repartition(n)).first()) for n in (1, 4)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = [sha(f'{{"doc_id":"{d}","predicted":[' + ",".join(f'{{"start":{a},"end":{b},"label":"{x}"}}' for a, b, x in p) + "]}") for d, p in rows]
    for _ in range(replay.DEPTH):
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    assert got == [(level[0], 20)] * 2
    other = spark.createDataFrame([*rows[:-1], ("d19", [(0, 2, "DATE")])], schema)
    assert replay.tree_hash(other).first()[0] != level[0] and replay.tree_hash(made.limit(0)).first()["documents"] == 0
    for bad in ([(2, 5, "DATE"), (0, 2, "NAME")], [(0, 3, "NAME"), (2, 5, "DATE")], [(0, 2, "OTHER")]):
        with pytest.raises(ValueError):
            replay.tree_hash(spark.createDataFrame([("a", bad)], schema))
    with pytest.raises(ValueError):
        replay.tree_hash(spark.createDataFrame([rows[1], rows[1]], schema))


JSON_FAULTS = {
    '[{"k": "a"}] []': "data after", '{"k": "a", "k": "b"}': "repeated", '{"k": "a"': "ends early", '[{"k": "a"}, 3]': "not an object", "3": "not an object", "[[]]": "not an object", '{"x": {"k": "a"}}': "missing",
    '{"k": [1, {"y": 2]}': "does not match", '[{"k": "a"}}': "does not match", '{"k": 01}': "malformed", '{"k": "a" "x": 1}': "out of place", '{"k" 1}': "out of place", '{"k": tru}': "malformed", '{"k": "a\nb"}': "malformed",
    '[{"k": 1},]': "does not match", '{"k": 1,}': "does not match", '{, "k": 1}': "out of place", '{"k": }': "does not match", "": "ends early", "{}": "missing", '[{"k": 1} {"k": 2}]': "out of place", '{"k": "\\x"}': "malformed",
}


@pytest.mark.parametrize("text", sorted(JSON_FAULTS))
def test_strict_json_refuses(text):
    with pytest.raises(ValueError, match=JSON_FAULTS[text]):
        tabular._items(text, ("k",))


def test_strict_json_equals_the_standard_parser(spark, tmp_path):
    import json
    import random

    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return [None, True, rng.randrange(-99, 99), rng.random() * 10 ** rng.randrange(-9, 9), "".join(rng.choices('ab"\\{}[],: é😀\n', k=rng.randrange(6)))][kind]
        return [value(depth - 1) for _ in range(rng.randrange(3))] if kind == 5 else {str(i): value(depth - 1) for i in range(rng.randrange(3))}

    for _ in range(500):
        items = [{"x": value(3), "k": value(2), "y": {"k": value(1)}} for _ in range(rng.randrange(4))]
        text = json.dumps(items, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        got = [k for (k,) in tabular._items(text, ("k",))]
        assert [x["k"] if isinstance(x["k"], (str, type(None))) else json.loads(k) for x, k in zip(items, got, strict=True)] == [x["k"] for x in items]
        assert [k for x, k in zip(items, got, strict=True) if isinstance(x["k"], (str, type(None)))] == [x["k"] for x in items if isinstance(x["k"], (str, type(None)))]
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"document_id": "d1", "gold": [{"group_id": "no"}], "group_id": "g"}, {"group_id": null, "document_id": "d\\u00fc"}]', encoding="utf-8")
    bad.write_text('[{"document_id": "d1", "group_id": "g"}] x', encoding="utf-8")
    assert [tuple(r) for r in tabular.read_identities(spark, str(good), strict=True).collect()] == [("d1", "g"), ("dü", None)]
    with pytest.raises(Exception, match="JSON is refused"):
        tabular.read_identities(spark, str(bad), strict=True).collect()
    rows = spark.createDataFrame([(1, "[]", 0), (2, None, 0), (3, '{"id": 4}', 0)], "id int, j string, item int")
    assert [tuple(r) for r in tabular.project_json(rows.select("id", "j"), "j", ("id",), ()).collect()] == [(0, None, "the text ends early"), (0, "4", None)]


def test_pairs_of_a_bucket_meet_by_their_prefixes_only(spark):
    """Texts that all share one band's values and a long passage, some of them similar: as by pairing them all up."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for i in range(400):
        own = rows[-1][1] if i % 8 == 7 else [rng.randrange(1 << 40) for _ in range(30)]
        rows.append((i, sorted(set(own[: len(own) - i % 3]) | set(range(12))), [7, 7, *[i] * 6]))
    signed = spark.createDataFrame([(i, s, g) for i, s, g in rows], "doc_id long, shingles array<long>, signature array<long>")
    want = similarity.verified(similarity.lsh_pairs(signed, None, "doc_id"), signed, signed, "doc_id")
    found = similarity.near_pairs(signed).withColumn("jaccard", F.round("jaccard", 9)).collect()
    assert sorted(found) == sorted(want.withColumn("jaccard", F.round("jaccard", 9)).collect()) and len(found) >= 40


def test_pattern_candidates_equal_their_sql(spark):
    """The patterns' edges, which the tables' texts do not meet, through the operator and the registered SQL."""
    import duckdb

    from quillspan.operators import candidates
    from quillspan.plans import registry

    texts = [
        "mail x.y+z@ab-c.example.com. (123) 555-0100, x(123) 555-0100 +1 (999)555-1234 then 2024-01-02 and March 3, 2021; 2024-01-023",
        "Your username is 'rjohnson_prime'. user id: bob; LOGIN ID the x a@b.c@d.e é(321) 555-9999", "(111) 555-22223 a2024-01-02 user name = q9x.,; username for me", None, "", "Word of Word Words",
    ]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = con.execute(registry.oracle_sql()["propose_candidates"]).fetchall()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gold = candidates.tokenize(docs, pattern=r"(?<![^ \n])[A-Z][a-z]{3,}(?![^ \n])").selectExpr("doc_id", "start", "`end`", "token as value", "elt(cast(pmod(length(token), 8) as int) + 1, 'a', 'b', 'c', 'd', 'e', 'f', 'g', 'h') as label")
    found = candidates.propose(docs, candidates.fit_dictionary(docs, gold)).select("doc_id", "start", "end", "label", "score").collect()
    rest = lambda rows: sorted(tuple(r) for r in rows if r[3] in ("EMAIL", "PHONE", "DATE", "USERNAME") and r[4] in (0.85, 0.8, 0.5))
    assert rest(found) == rest(want) and len(rest(want)) == 9
    assert sorted((r[0], r[1], r[2], round(r[4], 9)) for r in found) == sorted((r[0], r[1], r[2], round(r[4], 9)) for r in want)


def test_ks_of_more_pairs_than_32_bits_count(spark):
    df = spark.range(120_000).select((F.col("id") % 2 == 1).alias("s"), (F.col("id") % 7).alias("v"))
    row = stats.ks_statistic(df, F.col("s"), "v").first()
    assert (row["n_first"], row["n_second"]) == (60_000, 60_000) and row["statistic"] < 1e-4 and row["p_value"] == 1.0


def test_tokens_and_their_neighbours_are_read_where_the_text_lies(spark):
    docs = spark.createDataFrame([(1, "Ab-c\n d"), (2, None), (3, "\n x"), (4, "")], "doc_id long, text string")
    found = candidates.tokens_in_context(docs, reach=1)
    rows = [tuple(r) for r in found.collect()]
    assert rows == [
        (1, 0, 0, 2, "Ab", None, "-", None, 2, False, False), (1, 1, 2, 3, "-", "Ab", "c", 2, 3, False, False),
        (1, 2, 3, 4, "c", "-", "d", 3, 6, False, True), (1, 3, 6, 7, "d", "c", None, 4, None, True, False), (3, 0, 2, 3, "x", None, None, None, None, True, False),
    ]
    plan = features.token_features(candidates.tokens_in_context(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    codes = features.token_codes(found, features.vocabulary(candidates.tokenize(docs)))
    assert {(r["doc_id"], r["i"]): r["flags"][3:] for r in codes.collect()}[1, 3] == [1, 0, 0, 0]


def test_aligned_is_token_aligned(spark):
    docs = spark.createDataFrame([(1, "Ab-c d"), (2, None), (3, "x")], "doc_id long, text string")
    own = spark.createDataFrame([(1, 0, 2, "a"), (1, 0, 3, "b"), (1, 1, 4, "c"), (1, 2, 7, "d"), (2, 0, 1, "e"), (9, 0, 1, "f"), (3, 0, 1, "g"), (3, 0, 1, "g"), (3, None, 1, "h")], SPAN)
    columns = ["doc_id", "start", "end", "label", "first", "last"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(candidates.aligned(docs, own)) == key(candidates.token_aligned(candidates.tokenize(docs), own))


def test_root_is_that_of_bisection_with_fewer_slopes():
    for root, steep in ((0.3, 0.5), (1.0, 3.0), (2.345678, 1.0), (3.9, 4.0)):
        asked, low, high = [], 0.25, 4.0
        slope = lambda x: asked.append(x) or math.tanh(steep * (x - root))  # noqa: B023, E731
        got = calibration.falling_root(slope, low, high, 18)
        assert len(asked) <= 14
        for _ in range(18):
            mid = (low + high) / 2
            low, high = (mid, high) if slope(mid) < 0 else (low, mid)
        assert got == ((low + high) / 2, None)


def test_lattices_are_made_without_a_row_for_each_interval(spark):
    from quillspan.plans import spans as plans
    from tests.conftest import DATA

    made = plans.lattices(spark, DATA)
    assert not any(x in made._jdf.queryExecution().executedPlan().toString() for x in ("Generate", "Aggregate"))
    for r in made.limit(20).collect():
        assert list(zip(r["b"], r["a"], strict=True)) == [(b, a) for b in range(1, r["n"] + 1) for a in range(max(0, b - 16), b)]
        assert r["energies"] == [[((r["doc_id"] * 13 + a * m + b * 5) % 17 - 8) / 4 for m in (7, 11)] for a, b in zip(r["a"], r["b"], strict=True)]


def test_spans_in_context_leave_their_text_behind(spark):
    """Long texts: what is near a span is bounded, and the rest comes along only where the words near it are too few."""
    text = "first Second " + " " * 500 + "Third and then some more words Fourth." + " tail" * 5_000
    spans = [(1, text.index(w), text.index(w) + len(w), w) for w in ("Second", "Third", "Fourth")]
    docs = spark.createDataFrame([(1, text, "en"), (2, None, "en")], "doc_id long, text string, lang string")
    made = spark.createDataFrame([*spans, (2, 0, 3, "none"), (3, 0, 3, "gone")], "doc_id long, start int, end int, w string")
    got = {r["w"]: r for r in candidates.in_context(docs, made, keep=("lang",)).collect()}
    assert set(got) == {"Second", "Third", "Fourth", "none"} and got["none"]["value"] is None and got["Third"]["lang"] == "en"
    for _, start, end, w in spans:
        r = got[w]
        assert (r["value"], r["left"], r["right"], r["text_chars"]) == (w, text[max(0, start - 200) : start], text[end : end + 200], len(text))
        assert r["far_left"] == (text[:start] if w == "Third" else None) and r["far_right"] == (text[end:] if w == "Second" else None)
    shown = {r["phrase"]: r for r in features.mixed_features(candidates.in_context(docs, made.where("doc_id = 1").withColumns({"label": F.lit("NAME"), "score": F.lit(0.5)}))).collect()}
    assert [shown["third"][c] for c in ("left1", "left2", "right1", "right2")] == ["second", "first", "and", "then"]
    assert [shown["second"][c] for c in ("left_pair", "right_pair")] == ["first", "third and"] and shown["fourth"]["right_pair"] == ". tail"


def test_large_dictionaries_shuffle_what_may_occur(spark, monkeypatch):
    """Substrings that no phrase begins with are no rows of the join, and the result is that of the small dictionary."""
    docs = spark.createDataFrame([(i, "Alpha beta gamma, " + "delta epsilon zeta " * 40 + "Beta Alpha") for i in range(4)], "doc_id long, text string")
    phrases = spark.createDataFrame([("Alpha beta",), ("Alpha",), ("Beta",), ("beta",)], "phrase string")
    made, scan = [], candidates._scan
    monkeypatch.setattr(candidates, "_scan", lambda *a: made.append(scan(*a)) or made[-1])
    big = candidates.dictionary_join(docs, phrases)
    assert made[-1].count() == 4 * 5
    small = candidates.dictionary_hits(docs, phrases)
    assert audit.same_rows(small.select(sorted(small.columns)), big.select(sorted(small.columns)))


def test_hashes_of_runs_and_signatures_agree_with_the_shingles_texts(spark):
    """Signatures without the shingles' texts are those with them; runs are as many as distinct shingles."""
    texts = ["A b c  d e f a b c d e f g", "x\x1cy z w v u", "a b c d", "", None, "\u00a0Ä ö ü ß é ï \t ñ", "r " * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {r["doc_id"]: (r["signature"], len(r["shingles"] or [])) for r in similarity.with_signature(docs).collect()}
    assert {r["doc_id"]: r["signature"] for r in similarity.signatures(docs).collect()} == {i: s for i, (s, _) in want.items()}
    assert {r["id"]: r["n"] for r in similarity.hashed_sets(docs, "doc_id").collect()} == {i: n for i, (_, n) in want.items() if n}
    sides = docs.withColumnRenamed("doc_id", "id")
    assert {(r["a"], r["b"]): r["jaccard"] for r in similarity.cross_pairs(sides, sides).collect() if r["a"] == r["b"]} == {(i, i): 1.0 for i, (_, n) in want.items() if n}


def test_interval_plan_is_the_sampling_plan_without_a_shuffle_of_the_universe(spark):
    lengths = spark.createDataFrame([(1, 1), (2, 5), (3, 40), (4, 0), (5, 20)], "doc_id long, n int")
    gold = spark.createDataFrame([(2, 0, 2), (3, 3, 5), (3, 4, 5), (3, 38, 40), (5, 0, 17)], "doc_id long, a int, b int")
    old = spark.createDataFrame([(2, 0, 2), (2, 1, 3), (3, 20, 21), (5, 0, 16)], "doc_id long, a int, b int")
    for width in (3, 16):
        want = candidates.sampling_plan(candidates.span_universe(lengths, width), gold, old)
        got = candidates.interval_plan(lengths, gold, old, width)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_canonical_hash_takes_packed_rows(spark):
    """What is sent to the driver is packed on the way, and is far less than what is hashed."""
    import hashlib
    import json

    from quillspan.operators import replay

    rows = [(i, [(10 * j, 10 * j + 5, "NAME") for j in range(i % 40)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, predicted array<struct<start int, end int, label string>>").repartition(5)
    text = json.dumps([[i, [list(s) for s in p]] for i, p in rows], separators=(",", ":")).encode()
    assert replay.canonical_hash(df) == hashlib.sha256(text).hexdigest()
    packed = replay.packed_rows(df.orderBy("doc_id"), "doc_id", "predicted").collect()
    assert sum(len(r["packed"]) for r in packed) < len(text) / 5
