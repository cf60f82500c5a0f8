"""Periodic runs, exact dedup and tokenizer alignment against plain readings: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspan.llm import exact_dedup, periodic_runs, queries, sql, tokenizer_alignment
from tests.conftest import DATA, plain
from tests.llm.test_llm import DOCS, corpus

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts() -> list[tuple]:
    """The shared corpus, copies that differ in white space alone, words in periods, and characters that tokenizers treat apart."""
    more = ["al pha beta", "alpha\tbeta\n", "alphabeta", " alpha beta", "alpha  beta", "x y " * 40, "a a a a a a", "a a a a a", "one two three " * 4, "p q r s " * 3 + "p q r", "u v " * 9 + "u v w " * 7,
            "▁ of its own", "é́ł 　 ideographic", "<|endoftext|> <s> <unk> <0x41>", "tab\tand  spaces   and\r\nlines", "👩‍👩‍👧 ok 你好，世界", "don't we'll I'M", "\x00 nul", " lead", "trail ",
            *(" ".join(w * n + v * m) for w, v, n, m in ((["k", "l"], ["m"], 4, 6), (["k"], ["k", "k", "l"], 7, 5), (["r", "r", "s"], ["s", "r"], 4, 4), (["t"], ["v"], 6, 7)))]
    return corpus() + [(200 + i, t, "s0", "x", 1) for i, t in enumerate(more)] + [(220, "alphabeta", "s9", "x", 2), (220, "alphabeta", "s9", "x", 2), (None, "alphabeta", "s9", "x", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_texts(), DOCS).repartition(5).cache()


# ---------------------------------------------------------------- 11


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """All runs by comparing every place with the one a period later."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        same = [w[i] == w[i + q] for i in range(n - q)] + [False]
        start = 0
        for i, x in enumerate(same):
            if not x:
                length = i - start + q
                if i > start and length >= max(6, 4 * q) and not any(all(w[j] == w[j + p] for j in range(start, start + length - p)) for p in range(1, q)):
                    out.append((start, length, q))
                start = i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("kinds", [1, 2, 3, 5])
def test_runs_of_random_words_match_a_plain_reading(kinds):
    rng = random.Random(kinds)
    for _ in range(300):
        w = []
        while len(w) < rng.randint(0, 70):
            piece = [rng.randrange(kinds) for _ in range(rng.randint(1, 6))]
            w += piece * rng.choice([1, 1, 2, 4, 5]) + piece[: rng.randint(0, len(piece))]
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(w, np.int32)).tolist()] == plain_runs(w)


def test_extensions_are_longest():
    rng = random.Random(1)
    w = [rng.randrange(2) for _ in range(90)]
    levels = periodic_runs.names(np.array(w, np.int32))
    i, j = map(np.array, zip(*[(a, b) for b in range(91) for a in range(b)], strict=True))
    ahead, back = periodic_runs.extend(levels, i, j), periodic_runs.extend(levels, i, j, backward=True)
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    assert ahead.tolist() == [common(w[a:], w[b:]) for a, b in zip(i, j, strict=True)]
    assert back.tolist() == [common(w[:a][::-1], w[:b][::-1]) for a, b in zip(i, j, strict=True)]


def test_a_long_run_is_one_run_in_any_block(monkeypatch):
    w = np.concatenate([np.arange(50), np.tile([7, 8], 3000), np.arange(100, 150)]).astype(np.int32)
    want = periodic_runs.find_runs(w).tolist()
    assert want == [[50, 6000, 2]]
    monkeypatch.setattr(periodic_runs, "BLOCK", 100)
    assert periodic_runs.find_runs(w).tolist() == want


def plain_report(i, text) -> tuple:
    w = (text or "").encode().split()
    if i is not None and w and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_op11_matches_a_plain_reading(spark, docs):
    cut = lambda t: t if t is None or len(t.split()) < 700 else " ".join(t.split()[:700])  # noqa: E731 - the plain reading is quadratic
    rows = [(r[0], cut(r[1])) for r in odd_texts()]
    got = periodic_runs.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(plain, got)) == sorted(plain(plain_report(*r)) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 10 and max(r["n_runs"] for r in got) > 1
    assert periodic_runs.report(docs.limit(0)).collect() == []


def test_op11_query_over_documents(spark):
    want = [plain(plain_report(r.doc_id, r.text)) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if len((r.text or "").split()) < 500]
    got = {plain(r) for r in queries.op11_periodic_runs(spark, DATA).collect()}
    assert len(want) > 100 and set(want) <= got and len(got) >= len(set(want))


def test_detect_keeps_columns_and_collapses(spark):
    rows = [(1, "a b a b a b a b c", "r"), (2, None, "r"), (2, "", "s"), (None, "x", None)]
    got = periodic_runs.detect(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    assert got[0].asDict(recursive=True) == {"doc_id": 1, "text": rows[0][1], "runs": "r", "runs_": [{"start": 0, "length": 8, "period": 2}], "strongest": {"start": 0, "length": 8, "period": 2}, "collapsed": "a b c"}
    assert [(r["runs_"], r["strongest"], r["collapsed"]) for r in got[1:]] == [([], None, ""), ([], None, ""), ([], None, "x")]


# ---------------------------------------------------------------- 12


def test_op12_matches_sql(same_as_sql):
    same_as_sql(queries.op12_exact_dedup, sql.ORACLES["op12_exact_dedup"])


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_op12_matches_a_plain_reading(docs, parts):
    rows = odd_texts() + [(i % 7 or None, "the same text, everywhere" + " " * (i % 3), "s", "x", 1) for i in range(300)]
    got = exact_dedup.groups(docs.sparkSession.createDataFrame(rows, DOCS).repartition(parts)).collect()
    held = collections.defaultdict(list)
    for i, t, *_ in rows:
        held[squeezed(t)].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for t, members in held.items():
        members.sort()
        want += [(m[3], members[0][3], len(members), at == 0, hashlib.sha256(t.encode()).hexdigest()) for at, m in enumerate(members)]
    assert sorted(map(plain, got)) == sorted(map(plain, want))


def test_tree_has_a_level_for_each_round_and_bounded_lines(spark):
    rows = spark.range(0, 6000, 1, 300).select((F.col("id") % 5).alias("doc_id"), F.lit("a b").alias("text"))
    levels = exact_dedup.merge_tree(exact_dedup.rows_with_keys(rows))
    assert [x.count() for x in levels] == [300, 19, 2, 1] and levels[-1].first()["n"] == 6000


def test_dedup_keeps_whole_rows_once(spark, docs):
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    want = collections.Counter((r["doc_id"], r["text_sha256"]) for r in exact_dedup.groups(docs).where("kept").collect())
    got = collections.Counter((r["doc_id"], hashlib.sha256(squeezed(r["text"]).encode()).hexdigest()) for r in kept.collect())
    assert got == want and max(got.values()) == 1
    assert exact_dedup.dedup(docs.limit(0)).collect() == [] and exact_dedup.groups(docs.limit(0)).collect() == []


# ---------------------------------------------------------------- 13


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    """By the tokenizers library, byte ranges and every pair of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    letter = tokenizer_alignment.ByteLevel.letters()
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    done, count = [], collections.Counter()
    for i, text in rows:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        parts = [[bytes(letter[c] for c in a_side.id_to_token(x)) for x in a], [piece(x) for x in b]]
        if text and any(b"".join(p) != b" " + text.encode() for p in parts):
            a, b, parts = [], [], [[], []]
        ends = [np.cumsum([0, *map(len, p)]) for p in parts]
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()) - {0})
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(str(x) for x, s, e in zip(ids, c, c[1:], strict=False) if low <= s and e <= high) for ids, c in ((a, ends[0]), (b, ends[1]))))
            low = high
        linked = [(x, y) for x, s, e in zip(a, ends[0], ends[0][1:], strict=False) for y, u, v in zip(b, ends[1], ends[1][1:], strict=False) if s < v and u < e]
        count.update(linked)
        done.append((i, len(a), len(b), len(groups), linked, ";".join(groups)))
    top = collections.Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return [(i, n, m, g, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), sha(t)) for i, n, m, g, ls, t in done]


@pytest.mark.parametrize("share", [None, 40])
def test_op13_matches_a_plain_reading(spark, monkeypatch, share):
    if share:  # so that some pairs are rare and meet their documents by shuffle
        monkeypatch.setattr(tokenizer_alignment, "SHARE", share)
    rows = [(r[0], r[1] and r[1][:3000]) for r in odd_texts()]
    got = tokenizer_alignment.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B, public_tokenizers.PATTERN).collect()
    want = plain_alignment(rows)
    assert sorted(map(plain, got)) == sorted(map(plain, want))
    assert any(w[1] and w[3] < min(w[1], w[2]) for w in want) and any(r[1] and not w[1] for r, w in zip(rows, want, strict=True))


def test_op13_over_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") < 1200).select("doc_id", "text")
    got = tokenizer_alignment.report(docs, A, B, public_tokenizers.PATTERN).collect()
    assert sorted(map(plain, got)) == sorted(map(plain, plain_alignment([tuple(r) for r in docs.collect()])))


def test_ids_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(A)
    theirs.encode_special_tokens = True
    with open(A, "rb") as f:
        own = tokenizer_alignment.ByteLevel(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(6)
    pool = [chr(c) for c in [*range(1, 0x3000, 7), 0x85, 0xA0, 0x2028, 0x3000, 0xAC00, 0x1F600]] + list("  ab1'.\n\t<|>")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["<|endoftext|>"]
    assert [own.encode(t) for t in texts] == [e.ids for e in theirs.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_groups_and_links_of_an_aligned_table(spark, docs):
    got = tokenizer_alignment.align(docs, A, B, public_tokenizers.PATTERN)
    assert got.limit(0).collect() == [] and tokenizer_alignment.report(docs.limit(0), A, B, public_tokenizers.PATTERN).collect() == []
    for r in got.where("n_a > 0").collect():
        groups = [[side.split(",") for side in g.split("|")] for g in r["groups"].split(";")]
        assert len(groups) == r["n_groups"] and sum(len(g[0]) for g in groups) == r["n_a"] and sum(len(g[1]) for g in groups) == r["n_b"]
        assert sum(x["n"] for x in r["links"]) == r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]
