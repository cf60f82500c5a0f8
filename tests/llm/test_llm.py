"""The ten operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import byte_bpe, hmm_lm, mixing, quality_classifier, quality_rules, queries, simhash, sql, substring_dedup, topk_search, url_filters, warc
from tests.conftest import DATA, plain

DOCS = "doc_id long, text string, source string, _text string, fp long"


def corpus(n: int = 60, seed: int = 4) -> list[tuple]:
    """Documents with copies, shared passages, repeated rows, nulls, empty and long texts; extra columns with odd names."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi".split()) + rng.choice(["", ".", ","])
    passage = " ".join(f"{word()}{i % 7}" for i in range(60))
    rows = []
    for i in range(n):
        body = [" ".join(word() + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 15))) for _ in range(rng.randint(1, 12))]
        if i % 5 == 0:
            body.insert(rng.randint(0, len(body)), passage)
        rows.append((i, "\n".join(body), f"s{i % 3}" if i % 7 else None, "x", i))
    rows += [(100, rows[0][1], "s0", "x", 1), (100, rows[0][1], "s0", "x", 1), (None, rows[1][1], "s1", None, None), (101, None, "s1", "x", 1), (102, "", None, "x", 1), (103, " \n\t ", "s2", "x", 1), (104, "ab " * 3000, "s2", "x", 1), (105, "one", "s0", "x", 1), (106, "y" * 5000, "s0", "x", 1), (107, "Ünïcode 日本 😀 ok", "s0", "x", 1), (3, "another text under an id that is taken " * 8, "s1", "x", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def toks(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("name", sorted(set(sql.ORACLES) - {"op6_substring_dedup"}))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


# ---------------------------------------------------------------- 1


def test_hmm_counts_and_likelihood(spark, docs, none):
    trained = hmm_lm.train(docs, states=3, rounds=1)
    rows = hmm_lm.score(docs, trained).collect()
    count = collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t, *_ in corpus():
        if not held(i):
            count.update([x.lower() for x in toks(t)] + ["</s>"])
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [y.lower() for y in toks(t)] + ["</s>"])
    want = sorted((plain(i), held(i), len(toks(t)) + 1, round(base(t), 6)) for i, t, *_ in corpus())
    assert sorted((plain(r["doc_id"]), r["held_out"], r["n_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert hmm_lm.score(none, hmm_lm.train(none)).count() == 0


def test_hmm_recursions_match_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    emit = rng.random((4, 2))
    model = hmm_lm.Model(np.array([0.4, 0.6]), np.array([[0.7, 0.3], [0.2, 0.8]]), emit / emit.sum(axis=0))
    seqs = [np.array(s, np.int32) for s in ([0], [1, 2, 3, 0], [3, 3])]
    start, move, counts = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s, got in zip(seqs, hmm_lm.log10_likelihood(model, seqs), strict=True):
        paths = {p: model.start[p[0]] * np.prod([model.move[a, b] for a, b in zip(p, p[1:], strict=False)]) * np.prod([model.emit[o, k] for o, k in zip(s, p, strict=True)]) for p in itertools.product(range(2), repeat=len(s))}
        z = sum(paths.values())
        assert math.isclose(got, math.log10(z), abs_tol=1e-12)
        for p, w in paths.items():
            start[p[0]] += w / z
            for a, b in zip(p, p[1:], strict=False):
                move[a, b] += w / z
            for o, k in zip(s, p, strict=True):
                counts[o, k] += w / z
    for a, b in zip(hmm_lm.expected_counts(model, seqs), (start, move, counts), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_hmm_beats_its_base_on_held_out_text(spark):
    rows = queries.op1_hmm_lm(spark, DATA).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_hmm_rounds_cover_all_tokens_of_all_rows(spark):
    # the late tokens of a long text and every other training row count in every round
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(n))) for i, n in enumerate([7000, 5, 0, 300, 20, 40, 9000])]
    trained = hmm_lm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), states=3, rounds=2)
    classes = hmm_lm.Classes(trained.frequent)
    seqs = [classes.of(hmm_lm.tokens(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    share = trained.class_size / trained.class_size.sum()
    gen = np.random.default_rng(7)
    emit = share[:, None] * gen.gamma(1.0, size=(len(share), 3))
    move = np.full((3, 3), 0.1 / 3) + 0.9 * np.eye(3)
    model = hmm_lm.Model(np.full(3, 1 / 3), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    for _ in range(2):
        model = hmm_lm.maximized(*hmm_lm.expected_counts(model, seqs), share)
    assert np.allclose(trained.model.move, model.move, atol=1e-4) and np.allclose(trained.model.emit, model.emit, atol=1e-4)


# ---------------------------------------------------------------- 2


def test_classifier_learns_and_handles_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(out) == len(corpus()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert quality_classifier.score(none, quality_classifier.fit(none, labels.limit(0))).count() == 0
    real = queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in real]) >= 0.95


def test_compiled_rules_score_as_the_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality_classifier.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 4] < 0.6)).astype(float)
    model = quality_classifier.fit_rows(x, y)
    z = model.bias + sum(r.weight * r.holds(x) for r in model.rules)
    assert np.mean((z > 0) == (y == 1)) > 0.97 and len(model.rules) < 120
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[:50])], "i int, " + ", ".join(f"{s} double" for s in quality_classifier.STATS))
    got = [r[0] for r in df.orderBy("i").select(model.score(F.struct(*quality_classifier.STATS))).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z[:50])))


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_warc_round_trip_with_segments(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", broadcast)
    big = "é日" * 30_000
    rows = [(1, "a" * 2000), (2, "a" * 2000), (2, "a" * 2000), (3, "small"), (4, "small"), (5, None), (6, ""), (None, big), (7, big), (8, "x\r\n\r\nWARC/1.1\r\n\r\n" * 100), (None, "lonely" * 300)]
    pages = spark.createDataFrame([(p, h, "u", 1) for p, h in rows], "page_id long, html string, url string, digest int")
    got = sorted(plain([r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]) for r in warc.round_trip(pages).collect())
    want = []
    for p, h in rows:
        b = (h or "").encode()
        own = [q for q, g in rows if (g or "") == (h or "") and q is not None]
        revisit = len(b) >= 1000 and own and p != max(own)
        want.append(plain([p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(own) if revisit else None]))
    assert got == sorted(want)
    path = f"file://{tmp_path}/warc"
    warc.write(pages, path, segment=700)
    raw = warc.read(spark, path)
    whole = {r["page_id"]: r for r in warc.reassemble(raw).where("record_type = 'response'").collect()}
    assert bytes(whole[7]["payload"]).decode() == big and whole[7]["n_segments"] > 50
    with pytest.raises(Exception, match="segments"):
        warc.reassemble(raw.where("segment is null or segment <> 3")).collect()
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.unchunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# ---------------------------------------------------------------- 4


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in rng.normal(size=24)] for _ in range(300)]
    v[7] = v[9] = v[11]
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(20, v[20], 1), (400, None, 0), (420, [1.0, float("nan")], 0), (440, [1.0, None], 0), (460, [1.0] * 5, 0), (461, [2.0] * 5, 0), (None, v[0], 0), (480, [float("inf")] * 24, 0), (500, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, topk_search.every_nth(df), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.floor(64 * np.array(x, np.float32).astype(float))) for i, x, _ in rows if i is not None and x and all(y is not None and math.isfinite(y) for y in x)]
    queries_ = {i: x for i, x in ok if i % 20 == 0}
    assert set(got) == set(queries_)
    for q, x in queries_.items():
        best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:5]
        assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


# ---------------------------------------------------------------- 5


def test_simhash_components_match_brute_force(spark, docs, none, monkeypatch):
    import xxhash

    def fingerprint(t):
        w = [x.lower() for x in toks(t)]
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = corpus()
    out = simhash.components(docs).collect()
    assert sorted(plain([r["doc_id"], r["fingerprint"]]) for r in out) == sorted(plain([i, f"{fingerprint(t):016x}"]) for i, t, *_ in rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({fingerprint(t) for _, t, *_ in rows})
    assert simhash.components(none).count() == 0
    # near fingerprints, in small buckets and in ones above the bound
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(60)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, i in zip(fps, signed, strict=True):
        for b, j in zip(fps, signed, strict=True):
            if bin(a ^ b).count("1") <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    for bound in (4, 64):
        monkeypatch.setattr(simhash, "BUCKET", bound)
        edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
        assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in edges)
        up = {x: x for x in signed}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for r in edges:
            up[max(top(r["a"]), top(r["b"]))] = min(top(r["a"]), top(r["b"]))
        assert all(top(x) == root(x) for x in signed)


# ---------------------------------------------------------------- 6


def removed(texts, window):
    seen = collections.Counter()
    for t in texts:
        w = toks(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for t in texts:
        w = toks(t)
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_substring_dedup_matches_brute_force(docs, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 300)
    monkeypatch.setattr(substring_dedup, "FOLD", 40)
    rows = corpus()
    got = sorted(plain(list(r)) for r in substring_dedup.report(docs).collect())
    assert got == sorted(plain([i, *x]) for (i, *_), x in zip(rows, removed([t for _, t, *_ in rows], 35), strict=True))
    out = substring_dedup.remove(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and out.where("doc_id = 101 and text is null").count() == 1
    assert substring_dedup.report(none).count() == 0


def test_suffix_automaton():
    rng = random.Random(0)
    seqs = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 14))] for _ in range(6)]
    a = substring_dedup.SuffixAutomaton()
    for s in seqs:
        a.add(s, 1)
    a.close()
    for w in (2, 3, 5):
        seen = collections.Counter(tuple(s[i : i + w]) for s in seqs for i in range(len(s) - w + 1))
        for s in [*seqs, [b"a", b"z", b"b", b"a"]]:
            assert a.repeats(s, w) == [i for i in range(len(s) - w + 1) if seen[tuple(s[i : i + w])] >= 2]


# ---------------------------------------------------------------- 7


def test_bpe_matches_the_library(docs, none, monkeypatch):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    codec = byte_bpe.Codec(open(path, "rb").read(), P.PATTERN)
    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "'s", ".", "!!", "é", "日本", "1", "23", "\t", "\r\n", "xxxxx", "\x1c", "\u00a0", "😀"]
    with monkeypatch.context() as m:
        m.setattr(byte_bpe, "LEAF", 3)
        m.setattr(byte_bpe, "WINDOW", 2)
        for _ in range(800):
            s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
            assert codec.encode(s) == codec.leaf(s) and codec.decode(codec.encode(s)) == s.encode()
    out = {plain(list(r)) for r in byte_bpe.digests(docs, path, P.PATTERN).collect()}
    for i, t, *_ in corpus():
        ids = codec.leaf(t or "")
        assert plain([i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()]) in out
    whole = byte_bpe.encode(docs, path, P.PATTERN)
    assert whole.columns == [*docs.columns, "ids"] and whole.where("doc_id = 101 and size(ids) = 0").count() == 1
    assert byte_bpe.digests(none, path, P.PATTERN).count() == 0
    assert tiktoken.Encoding


# ---------------------------------------------------------------- 8


def test_url_filters(spark):
    urls = ["http://com/en/1", "https://A.Example.COM/en/71?x", "x://example.com/en/8", "ftp://notexample.com/en/7", "http://example.net/de/8#f", "http://a.net/fr/", "no scheme", None, "http://", "://org/es/q", "http://h.org?es/", "http://" + "a." * 500 + "com/en/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(1, urls[1], "x", "y"), (None, urls[0], "x", "y")], "page_id long, url string, host string, rule string")
    out = collections.defaultdict(list)
    for r in url_filters.judge(pages, url_filters.rule_table(spark)).collect():
        out[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert out[1] == [("a.example.com", "/en/71", "example.com/en/7", "allow")] * 2
    assert [out[i][0][2:] for i in (0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)] == [("com/en/", "block"), ("com/en/", "block"), ("com/en/", "block"), ("example.net/de/8", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/es/", "block"), (None, "allow"), ("com/en/", "block")]
    assert len(out[None]) == 1 and out[7][0][:2] == ("", "")
    assert url_filters.judge(pages.limit(0), url_filters.rule_table(spark)).count() == 0
    assert url_filters.judge(pages, url_filters.rule_table(spark, ())).where("verdict = 'block'").count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    assert url_filters.RULES == (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
    pages = spark.createDataFrame([(0, "http://a.net/de/1"), (1, "http://b.example.net/de/7"), (2, "http://b.example.net/de/81")], "page_id long, url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, url_filters.rule_table(spark), default="block").collect()}
    assert out == {0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block")}


# ---------------------------------------------------------------- 9


def test_mixing(spark, docs, none):
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(corpus())
    sizes = collections.Counter()
    for _, t, s, *_ in corpus():
        sizes[s] += len(toks(t))
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1, 5], strict=True))
    while open_:
        over = [s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * sizes[s]]
        if not over:
            goal |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            del open_[s]
    by_size = collections.defaultdict(set)
    for r in rows:
        by_size[r["source_size"]].add(round(r["target"], 6))
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert by_size == {sizes[s]: {round(g, 6)} for s, g in goal.items()}
    largest = max(len(toks(t)) for _, t, *_ in corpus())
    got = collections.Counter()
    for r in rows:
        got[r["source_size"]] += r["taken"]
    assert all(abs(got[sizes[s]] - g) <= largest for s, g in goal.items())
    assert sorted(map(plain, mixing.taken(docs.repartition(7)).collect())) == sorted(map(plain, rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(toks(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert mixing.taken(none).count() == 0


# ---------------------------------------------------------------- 10


def test_quality_rules(docs, none):
    def stats(t):
        w, t = toks(t), t or ""
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)

    want = []
    for i, t, *_ in corpus():
        n, *rest = stats(t)
        want.append(plain([i, n, *rest, n < 50 or 100 * rest[-1] > 50 * n]))
    out = quality_rules.judge(docs)
    got = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(plain(list(r)) for r in got.collect()) == sorted(want)
    assert quality_rules.judge(none).count() == 0 and quality_rules.filter(none).columns == docs.columns


def test_lines_above_their_limit(spark):
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    line = " ".join(f"c{j}" for j in range(80))
    rows = [(i, f"{line}\n{t}" if i < 20 else t, "a") for i, t in enumerate(own)] + [(100 + i, f"  {line.upper()} \n{own[0]} a", "b") for i in range(3)] + [(5, f"{line}\n{own[5]}", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {(r["doc_id"], r["n_line_words_removed"], r["kept"]) for r in quality_rules.judge(df, line_docs=5, line_share=0.1).collect()}
    # in host a the line stands in 20 texts: the first keeps it, the others lose 80 of 140 words and are depleted
    assert {(0, 0, True), (1, 80, False), (5, 80, False), (25, 0, True), (100, 0, True)} <= out
    kept = {r["doc_id"]: r["text"] for r in quality_rules.filter(df, line_docs=5, line_share=0.1).collect()}
    assert set(kept) == {0, *range(20, 30), 100, 101, 102} and line in kept[0]


def test_windows_fall_back_to_full_hashes(spark):
    w = F.split(F.lit("a b c a b c d a b c"), " ")
    full = spark.range(1).select(quality_rules.repeated_window_words(w)).first()[0]
    assert full == 9


# ---------------------------------------------------------------- pipeline


def test_pipeline_keeps_one_of_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for g in range(8):
        base = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(200)]
        for k in range(5):
            w = list(base)
            for at in rng.sample(range(200), k if g % 2 else 4 * k):
                w[at] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w), "s"))
    rows += [(900, rows[0][1], "s"), (900, rows[0][1], "s"), (None, rows[1][1], "s"), (901, None, "s"), (902, " ", "s"), (903, "A b", "s"), (904, "a  B", "s")]
    sets = []
    for _, t, _ in rows:
        w = [x.lower() for x in toks(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs, DATA)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({rows[top(i)][0] for i in range(len(rows))})
    assert dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs.limit(0), DATA).count() == 0


def test_pipeline_cuts_a_common_line_of_a_small_source(spark):
    import corpus_pipeline

    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    # a line of 8 among 30 texts of source a; b has 6 texts with the line among 6 and 294 copies of one other
    rows = [(i, f"a common line\n{t}" if i < 8 else t, "a") for i, t in enumerate(own)]
    rows += [(100 + i, f"line of b\n{t} b", "b") for i, t in enumerate(own[:6])] + [(200 + i, f"{own[9]} b", "b") for i in range(294)]
    out = dict(corpus_pipeline.STAGES)["quality rules"](spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), DATA)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(text) == len(rows)
    assert [i for i in text if "a common line" in text[i]] == [0] and [i for i in text if "line of b" in text[i]] == [100]


def test_pipeline_decodes_its_ids(spark, monkeypatch):
    import corpus_pipeline
    import public_tokenizers as P

    docs = spark.createDataFrame([(1, "some words 12", "s"), (2, None, "s")], "doc_id long, text string, source string")
    last = dict(corpus_pipeline.STAGES)["byte-level BPE"]
    assert last(spark, docs, DATA).count() == 2
    monkeypatch.setattr(P, "PATTERN", "[a-z]+")  # drops what is no letter
    with pytest.raises(Exception, match="do not decode"):
        last(spark, docs, DATA).collect()


# ---------------------------------------------------------------- more of the contracts


def test_hmm_scores_match_a_plain_model_and_ignore_the_layout(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "PART", 50)  # longer texts are trained on in linked parts
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{min(rng.randint(0, 40), rng.randint(0, 4000))}" for _ in range(n))) for i, n in enumerate([300, 7, 0, 45, 120, 30, 49, 51, 5, 64])] + [(None, "w1 W2"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(plain([r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 4)]) for r in hmm_lm.score(d, hmm_lm.train(d, states=3, rounds=3)).collect()) for d in (df.repartition(1), df.repartition(4, "text"))]
    assert got[0] == got[1]
    count = collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    token = lambda t: [*((t or "").lower().encode().split()), b""]
    for i, t in rows:
        if not held(i):
            count.update(token(t))
    n = sum(count.values())
    frequent = sorted(w for w, c in count.items() if w and c * hmm_lm.CLASS_SHARE >= n)
    of = lambda w: 0 if not w else 1 + frequent.index(w) if w in frequent else 1 + len(frequent) + zlib.crc32(w[-4:]) % hmm_lm.SUFFIX_CLASSES
    size = np.ones(1 + len(frequent) + hmm_lm.SUFFIX_CLASSES)
    for w, c in count.items():
        size[of(w)] += c + 1
    share = size / size.sum()
    gen = np.random.default_rng(7)
    emit = share[:, None] * gen.gamma(1.0, size=(len(share), 3))
    move = np.full((3, 3), 0.1 / 3) + 0.9 * np.eye(3)
    model = hmm_lm.Model(np.full(3, 1 / 3), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    for _ in range(3):  # plain forward and backward passes in doubles
        start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros_like(model.emit)
        for i, t in rows:
            if held(i):
                continue
            x = [of(w) for w in token(t)]
            alpha, beta = np.zeros((len(x), 3)), np.ones((len(x), 3))
            for k, o in enumerate(x):
                alpha[k] = (alpha[k - 1] @ model.move if k else model.start) * model.emit[o]
                alpha[k] /= alpha[k].sum()
            for k in range(len(x) - 1, 0, -1):
                beta[k - 1] = model.move @ (model.emit[x[k]] * beta[k])
                beta[k - 1] /= beta[k - 1].sum()
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            start += gamma[0]
            for k, o in enumerate(x):
                emits[o] += gamma[k]
                if k:
                    xi = alpha[k - 1][:, None] * model.move * (model.emit[o] * beta[k])
                    moves += xi / xi.sum()
        model = hmm_lm.maximized(start, moves, emits, share)
    want = []
    for i, t in rows:
        x, a, log = token(t), model.start, 0.0
        for k, w in enumerate(x):
            a = (a @ model.move if k else model.start) * model.emit[of(w)]
            log += math.log10(a.sum()) + math.log10((count[w] + 1) / size[of(w)])
            a = a / a.sum()
        want.append((i, len(x), sum(count[w] > 0 for w in x), log))
    scores = sorted(plain([i, n, k, round(s, 2)]) for i, n, k, s in want)
    assert scores == sorted(plain([r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 2)]) for r in hmm_lm.score(df, hmm_lm.train(df, states=3, rounds=3)).collect())


def plain_statistics(t: str | None) -> dict[str, float]:
    import unicodedata

    t = t or ""
    w, chars = [x.decode() for x in toks(t)], max(1, len(t))
    lines = [x for x in t.split("\n") if toks(x)]
    share = lambda n: n / max(1, len(w))
    return {
        "log_chars": math.log1p(len(t)), "log_words": math.log1p(len(w)), "mean_word": share(sum(map(len, w))),
        "upper": sum(unicodedata.category(c) == "Lu" for c in t) / chars, "symbols": sum(c in "#*$%&|<>" for c in t) / chars,
        "marks": sum(c in "!?" for c in t) / chars, "digits": sum(c in "0123456789" for c in t) / chars,
        "distinct": share(len(set(w))), "adjacent": share(sum(x == y for x, y in zip(w, w[1:], strict=False))),
        "line_words": len(w) / max(1, len(lines)), "distinct_lines": len(set(lines)) / max(1, len(lines)),
        "pauses": share(sum(x[-1] in ".,;:" for x in w)), "bare": share(sum(len(x) == 1 for x in w)),
    }


def test_classifier_statistics_by_a_plain_reading(spark):
    texts = [t for _, t, *_ in corpus()] + ["A B b b! 10% of #1\n\n A B b b! 10% of #1\nÉÀ x: y; |z| <q> ? .", "!", "\n", "a  a\ta"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"].asDict() for r in df.select("i", quality_classifier.statistics(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = plain_statistics(t)
        assert tuple(want) == quality_classifier.STATS == tuple(got[i])
        for name, v in want.items():
            assert math.isclose(got[i][name], v, rel_tol=1e-12, abs_tol=1e-12), (t, name)
    # every statistic tells some of the texts apart
    assert all(len({round(got[i][n], 9) for i in got}) > 1 for n in quality_classifier.STATS)


def test_registered_scores_follow_from_the_rules(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality_classifier.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert model.rules
    got = {r["doc_id"]: r for r in queries.op2_quality_classifier(spark, DATA).collect()}
    for r in docs.select("doc_id", "text").collect():
        s = list(plain_statistics(r["text"]).values())
        total = model.bias + sum(rule.weight for rule in model.rules if all((s[j] > t) == above for j, above, t in rule.tests))
        score = 1 / (1 + math.exp(-total))
        # thresholds lie between values of the statistics, so rounding decides none
        assert math.isclose(got[r["doc_id"]]["score"], score, rel_tol=1e-9) and got[r["doc_id"]]["predicted"] == int(score >= 0.3)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_classifier_takes_a_bounded_sample_whatever_is_repeated(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i % 40, f"word {'A' * (i % 40 % 2)} {i % 7}") for i in range(4000)], "doc_id long, text string")
    seen = []
    real = quality_classifier.fit_rows
    try:
        quality_classifier.fit_rows = lambda x, y: seen.append(len(x)) or real(x, y)
        quality_classifier.fit(docs, labels, sample=100)
    finally:
        quality_classifier.fit_rows = real
    assert seen == [100]


def test_topk_prunes_and_stays_exact_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    # vectors whose mass lies in few dimensions: bounds from the longest vectors bite early
    x = np.floor(64 * rng.normal(size=(6000, 64)) * np.geomspace(4, 0.01, 64))
    ids = np.arange(len(x))
    cold = topk_search.Search(ids[::50], x[::50], 10)
    warm = topk_search.Search(ids[::50], x[::50], 10)
    longest = np.argsort(-np.square(x).sum(axis=1))[:500]
    first = topk_search.Search(ids[::50], x[::50], 10)
    first.offer(ids[longest], x[longest])
    warm.warm = first.floors()
    for at in range(0, len(x), 1000):
        for s in (cold, warm):
            s.offer(ids[at : at + 1000], x[at : at + 1000])
    assert cold.full == warm.full == x.size * 120 and warm.steps < 0.5 * warm.full and warm.steps < cold.steps
    table = x[::50] @ x.T
    table[np.arange(120), ids[::50]] = -np.inf
    for s in (cold, warm):
        for q in range(120):
            best = np.lexsort((ids, -table[q]))[:10]
            assert s.found[q].tolist() == best.tolist() and s.scores[q].tolist() == table[q][best].tolist()
    # scores next to each other above 2^53, and ones no long can hold
    big = 2.0**30
    rows = [(0, [big, 1.0]), *((i, [big, float(i)]) for i in range(1, 6)), (20, [1e300, 1.0]), (40, [-1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk_search.top_k(df, topk_search.every_nth(df), k=6, scale=2.0).orderBy("query_id", "rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out if r["query_id"] == 0] == [(20, 2**63 - 1), *((i, 2**62 + 4 * i) for i in (5, 4, 3, 2, 1))]
    assert [(r["vec_id"], r["score"]) for r in out if r["query_id"] == 40] == [(i, -(2**63)) for i in (0, 1, 2, 3, 4, 5)]  # equal as given, so by id


def test_simhash_component_ids(spark):
    import xxhash

    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 500)}" for _ in range(400)]
        for k in range(4):
            w = list(base)
            for at in rng.sample(range(400), 3 * k):
                w[at] = f"n{rng.randint(0, 9999)}"
            rows.append((1000 - len(rows), " ".join(w)))
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[9][1]), (None, "lone words of no id"), (7, None), (8, "")]

    def fingerprint(t):
        w = (t or "").lower().encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                up[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min((x for x in (low.get(top(i)), d) if x is not None), default=None)
    assert len({top(i) for i in range(len(rows))}) < len(set(fps))
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(plain(list(r)) for r in got) == sorted(plain([d, f"{fps[i]:016x}", low[top(i)]]) for i, (d, _) in enumerate(rows))


def test_mixing_takes_repeated_rows_one_by_one(spark):
    rows = [(None, "a b c d e f g h i j", "s", i) for i in range(40)] + [(1, "k l m", "s", 0), (2, "n " * 30, "s", 0), (3, "o " * 7, "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(5)
    out = mixing.taken(df).collect()
    target, took = {r["source_size"]: r["target"] for r in out}, collections.Counter()
    for r in out:
        took[r["source_size"]] += r["taken"]
        assert r["taken"] % max(1, r["size"]) == 0
    assert all(abs(took[s] - t) <= 2 for s, t in target.items()) and len({r["taken"] for r in out if r["size"] == 10}) == 2
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and sum(len(toks(r["text"])) for r in mixed.collect()) == sum(took.values())


@pytest.mark.parametrize("bits", [60, 2])
def test_windows_with_clashing_prefixes_and_long_texts(spark, monkeypatch, bits):
    rng = random.Random(bits)
    texts = [" ".join(rng.choice("abcdef") + rng.choice(["", "1", "2"]) for _ in range(n)) for n in (0, 2, 3, 4, 30, 200, 700)]
    monkeypatch.setattr(quality_rules, "_POS_BITS", bits)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", quality_rules.repeated_window_words(F.filter(F.split("t", " "), lambda w: w != "")).alias("n")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        assert got[i] == len({k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)})


def test_encode_keeps_a_column_of_its_own_name(spark):
    import public_tokenizers as P

    docs = spark.createDataFrame([(1, "some words", "mine")], "doc_id long, text string, ids string")
    out = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "ids_"] and out.first()["ids"] == "mine" and len(out.first()["ids_"]) == 2


def test_key_filter_splits_without_loss(spark):
    from quillspan.operators.keyfilter import key_filter, split

    rows = spark.range(3000).select(F.col("id").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("b"))
    keys = rows.where("a % 5 = 0")
    some, none = split(rows, key_filter(keys, "a", "b"), "a", "b")
    assert some.count() + none.count() == 3000 and some.join(none, "a").count() == 0 and keys.join(none, "a").count() == 0 and none.count() > 2300
    some, none = split(rows, key_filter(keys.limit(0), "a", "b"), "a", "b")
    assert some.count() == 0 and none.count() == 3000
