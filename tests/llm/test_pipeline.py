"""The corpus pipeline against a plain reading of its five stages, on odd rows, stage by stage and as a whole."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _text string, x_0 int, copies string, _k string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
STAGES = dict(corpus_pipeline.STAGES)


def rows() -> list[dict]:
    """Documents with copies, near copies, shared passages and lines, repeated rows, nulls, empty and long texts."""
    rng = random.Random(11)
    word = lambda: f"{rng.choice('kor lam mun tes vil'.split())}{rng.randint(0, 3000)}"
    passage = " ".join(word() for _ in range(60))
    line = "A line that  many share"
    texts = []
    for i in range(40):
        body = [" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(4, 8))]
        if i % 6 == 0:
            body.insert(1, passage)
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), line if i % 2 else line.upper() + "\t")
        texts.append("\n".join(body))
    for i in range(0, 12, 3):  # near copies of falling likeness
        w = texts[i].split(" ")
        for k in range(1, 4):
            v = list(w)
            for at in rng.sample(range(len(v)), 2 * k * k):
                v[at] = word()
            texts.append(" ".join(v))
    texts += [texts[5], texts[5], "short text", "again and again " * 40, " ".join(word() for _ in range(4000)), "Ünïcode 日本 😀 " + texts[7][:600]]
    out = [(i, t, f"s{i % 3}" if i % 11 else None) for i, t in enumerate(texts)]
    out += [(200, None, "s1"), (201, "", "s1"), (202, " \n\t", None), (None, texts[2], "s0"), (None, texts[20] + " more", "s2"), (3, texts[3], "s0"), (3, texts[3], "s0"), (4, "other words under an id that is taken " + texts[9], "s1")]
    return [dict(zip(NAMES, (i, t, "en", s, None if t is None else len(t), "q", "w", 7, "c", "k"), strict=True)) for i, t, s in out]


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def key(r: dict) -> tuple:
    return r["doc_id"] is None, r["doc_id"] or 0


def quality(docs: list[dict]) -> list[dict]:
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    low = lambda r: -(2**63) if r["doc_id"] is None else r["doc_id"]
    hosts, seen, first = collections.defaultdict(set), collections.defaultdict(set), {}
    for r in docs:
        hosts[r["source"]].add(r["text"] or "")
        for x in lines(r["text"]):
            at = r["source"], norm(x)
            seen[at].add(r["text"])
            first[at] = min(first.get(at, 2**63), low(r))
    over = {at for at, ts in seen.items() if len(ts) > 5 and len(ts) > 0.02 * len(hosts[at[0]])}
    out = []
    for r in docs:
        w = words(r["text"])
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        if len(w) < 50 or 100 * len(cover) > 50 * len(w):
            continue
        cut = {norm(x) for x in lines(r["text"]) if (r["source"], norm(x)) in over and first[r["source"], norm(x)] != low(r)}
        text = "\n".join(x for x in r["text"].split("\n") if norm(x) not in cut) if cut else r["text"]
        if len(words(text)) >= 0.5 * len(w):
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def near(docs: list[dict]) -> list[dict]:
    def shingles(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(r["text"]) for r in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    best = {}
    for i, r in enumerate(docs):
        g = top(i)
        if g not in best or (*key(r), signed(r["text"])) < (*key(best[g]), signed(best[g]["text"])):
            best[g] = r
    return list(best.values())


def repeats(docs: list[dict]) -> list[dict]:
    count, out = collections.Counter(), []
    for r in docs:
        w = words(r["text"])
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for r in docs:
        w = words(r["text"])
        gone = {i + j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(35)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"]
        out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def mixed(docs: list[dict]) -> list[dict]:
    size = collections.Counter()
    for r in docs:
        size[r["source"]] += len(words(r["text"]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    goal, left, open_ = {}, 1.5 * sum(size.values()), set(size)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2.0 * size[s] for s in full}
        left -= sum(goal[s] for s in full)
        open_ -= full
    out = []
    for s in size:
        whole = int(goal[s] // size[s]) if size[s] else 0
        rest = goal[s] - whole * size[s]
        own = [(len(words(r["text"])), r) for r in docs if r["source"] == s and words(r["text"])]
        level, sizes = 0.0, sorted({n for n, _ in own}, reverse=True)
        for n in sizes:  # the largest first for certain, until the level leaves none of the others certain
            sure = sum(m for m, _ in own if m > n)
            level = (rest - sure) / sum(m * m**0.5 for m, _ in own if m <= n)
            if level * n**0.5 <= 1:
                break
        ranked = []
        for n, r in own:
            digest = hashlib.md5((r["text"] or "").encode()).hexdigest()
            u = (int(hashlib.md5(f"mix:{'null' if r['doc_id'] is None else r['doc_id']}:{digest}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = min(1.0, level * n**0.5)
            odds = 0.0 if p >= 1 else 1.0 if p <= 0 else u * (1 - p) / (u * (1 - p) + (1 - u) * p)
            ranked.append((odds, u, n, digest, r["doc_id"] is not None, r["doc_id"] or 0, r))
        ranked.sort(key=lambda x: x[:-1])
        more, so_far = [], 0
        for x in ranked:
            more.append(so_far + x[2] / 2 <= rest)
            so_far += x[2]
        gap = rest - sum(x[2] for x, m in zip(ranked, more, strict=True) if m)
        others = [i for i, m in enumerate(more) if not m]
        if gap > 0 and others:
            i = min(others, key=lambda i: (abs(gap - ranked[i][2]), *ranked[i][:-1]))
            more[i] = abs(gap - ranked[i][2]) < gap
        for x, m in zip(ranked, more, strict=True):
            out += [x[-1]] * min(2, whole + m)
    return out


def same(df, want: list[dict], names=NAMES) -> None:
    assert df.columns == list(names)
    assert sorted(plain([r[c] for c in names]) for r in df.collect()) == sorted(plain([r[c] for c in names]) for r in want)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows()], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def test_each_stage_and_the_whole_by_a_plain_reading(spark, folder):
    docs, want = spark.read.parquet(f"{folder}/documents.parquet"), rows()
    for name, by_hand in (("quality rules", quality), ("near-dedup", near), ("substring dedup", repeats), ("mixing", mixed)):
        docs, before = STAGES[name](spark, docs, folder), want
        want = by_hand(want)
        assert want != before, f"{name} has something to do"
        same(docs, want)
        docs = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in want], SCHEMA).repartition(3)
    import public_tokenizers as P

    import base64

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines() if x)}
    library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    last = [{"doc_id": r["doc_id"], "source": r["source"], "ids": (i := library.encode_ordinary(r["text"])), "n_tokens": len(i)} for r in want]
    same(corpus_pipeline.run(spark, folder), last, ["doc_id", "source", "n_tokens", "ids"])


@pytest.mark.parametrize("name", list(STAGES))
def test_a_stage_takes_odd_rows_alone(spark, name):
    odd = [r for r in rows() if r["doc_id"] is None or r["doc_id"] >= 200 or not r["text"]] * 2
    docs = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in odd], SCHEMA)
    out = STAGES[name](spark, docs, "")
    if name == "byte-level BPE":
        assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() == len(odd)
        assert out.where("doc_id >= 200 and doc_id < 202 and n_tokens = 0").count() == 4
    else:
        same(out, {"quality rules": quality, "near-dedup": near, "substring dedup": repeats, "mixing": mixed}[name](odd))
    empty = STAGES[name](spark, docs.limit(0), "")
    assert empty.columns == out.columns and empty.count() == 0
    few = STAGES[name](spark, docs.select("doc_id", "text", "source").where(F.col("text").isNull()), "")
    assert few.count() == {"quality rules": 0, "near-dedup": 1, "substring dedup": 2, "mixing": 0, "byte-level BPE": 2}[name]


def test_near_dedup_links_by_fingerprints_on_the_ring(spark):
    """Without a MinHash key in common, the pigeonring's pairs still link what is similar, and only that."""
    from quillspan.llm import near_copies, simhash
    from quillspan.operators import near as links_of

    rng = random.Random(5)
    texts = []
    for _ in range(6):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(900)]
        texts += [" ".join(w), " ".join([*w[:-1], "other"]), " ".join([*w[:-2], "yet", "another"])]
    sets = [near_copies.shingle_set(t) for t in texts]
    bits = [simhash.folded(s) & (2**64 - 1) for s in sets]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 2}
    true = {(i, j) for i, j in close if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert len(true) >= 6
    rows = spark.createDataFrame([(i, [i], simhash.folded(s)) for i, s in enumerate(sets)] + [(99, [99], simhash.folded(sets[0]))], "h long, keys array<long>, fp long")
    pairs = near_copies.ring_pairs(rows)
    assert (0, 99) in {tuple(r) for r in pairs.collect()}
    held = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)] + [(99, [1, 2, 3])], "h long, s array<long>")
    found = {tuple(r) for r in links_of.links(rows.select("h", "keys"), lambda wanted: held.join(wanted, "h"), pairs).collect()}
    assert found and all((b, a) in true for a, b in found)  # the text under an equal fingerprint that shares no shingle is not linked

    def parts(edges):
        up = list(range(len(texts)))
        for _ in texts:
            for i, j in edges:
                up[i] = up[j] = min(up[i], up[j])
        return up

    assert parts(found) == parts(true)
