"""Substring dedup with suffix automata over reference shards.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that covers it has a word
sequence that also starts somewhere else, in any document.

1. Anchors. Of a window's runs of ``GRAM`` words, the one of least hash is its anchor; equal windows have
   equal anchors. Anchors are counted over all documents, and only windows whose anchor stands twice or
   more can repeat.
2. Shards. The words under the windows of one such anchor are a passage. Passages travel to the reference
   shard of their anchor's hash, so all occurrences of a window meet in one shard. Each task first folds
   equal passages that it reads itself, so a passage that many documents share reaches its shard once a
   task; windows of anchors above ``HOT`` occurrences travel one by one under their own hash.
3. Automata. A shard's distinct passages form a suffix automaton over words, with the number of
   occurrences at each state. The passages are streamed through it; the matching statistic, held at the
   window's length, gives each window's number of occurrences, and the maximal spans covered by windows
   that occur twice or more go back to their documents.

The automata are built where a shard's passages meet instead of being broadcast: with a broadcast, every
document would be read once for every shard of the corpus, which grows with the square of the corpus.

Defined results: a null or empty text has no words and none is removed; a text of fewer words than the
window loses none; repeated rows count as elsewhere for each other; a null id is an id; an empty table gives
an empty table; extra columns are kept by ``remove`` and ignored by ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quillspan.operators.keyfilter import key_filter, split
from quillspan.sources.scratch import discard, materialize

WINDOW, GRAM = 35, 8
#: Rows whose texts are held at once where texts are written.
ROWS = 256
#: Words of a shard's automaton; passages folded in a task at once.
SHARD_WORDS, FOLD = 60_000, 60_000
#: Occurrences above which an anchor's windows travel one by one: below it, its passages of some 60 words fill a shard at most.
HOT = SHARD_WORDS // 60
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _values(column: pa.Array) -> Iterator:
    """A column's values one by one, so that only one text is held as a Python string."""
    return (x.as_py() for x in column)


class Hashes(dict):
    """Word -> 64-bit hash, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def anchors(words: list[bytes], hashes: Hashes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for each window of a text, and the hash of the run at each place."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - GRAM + 1
    run = np.zeros(n, np.uint64)
    for j in range(GRAM):
        run = run * _MULT + h[j : j + n]
    run ^= run >> np.uint64(29)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(32)
    span = window - GRAM + 1
    place = np.empty(n - span + 1, np.int64)
    for at in range(0, len(place), 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(run[at : at + (1 << 16) + span - 1], span)
        place[at : at + len(view)] = view.argmin(axis=1) + np.arange(at, at + len(view))
    return place, run


class SuffixAutomaton:
    """Suffix automaton of several word sequences, each with a number of occurrences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A copy of q for the suffixes that p's move on ``word`` reaches."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[bytes], times: int) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                last = new
            self.count[last] += times

    def close(self) -> None:
        """Add up occurrences along suffix links; after this, nothing is added."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeats(self, sequence: list[bytes], window: int) -> list[int]:
        """Starts of the windows of ``sequence`` that occur twice or more, by matching statistics."""
        state, matched, out = 0, 0, []
        moves, link, length = self.next, self.link, self.length
        for i, word in enumerate(sequence):
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            if word in moves[state]:
                state, matched = moves[state][word], matched + 1
            while state and length[link[state]] >= window:
                state = link[state]
            if matched > window:
                matched = window
            if matched == window and self.count[state] >= 2:
                out.append(i - window + 1)
        return out


def _keyed(docs: DataFrame, text: str, doc_id: str) -> tuple[Column, Column]:
    """A document's key: its id and its text's hash."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k1"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("k2")


def _anchor_rows(slim: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, first = Hashes(), TaskContext.get().partitionId() << 36
        for b in batches:
            places, runs = [], []
            for x in _values(b.column("text")):
                place, run_hash = anchors(_tokens(x), hashes, window)
                place = np.unique(place)
                places.append(place.astype(np.int32))
                runs.append(run_hash[place].view(np.int64))
            ids = pa.array(range(first, first + b.num_rows), pa.int64())
            first += b.num_rows
            yield pa.RecordBatch.from_arrays([ids, b.column("k1"), b.column("k2"), pa.array(places, pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.int64()))], ["rid", "k1", "k2", "place", "h"])

    return slim.mapInArrow(run, "rid long, k1 long, k2 long, place array<int>, h array<long>")


_PASSAGE = pa.schema([("h", pa.int64()), ("passage", pa.binary()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


class _Fold:
    """Passages read by one task, equal ones folded. A passage met twice repeats wherever it stands, so its places are known at once."""

    def __init__(self):
        self.seen: dict[tuple[int, bytes], list] = {}
        self.known: list[tuple] = []

    def add(self, h: int, passage: bytes, place: tuple) -> None:
        got = self.seen.setdefault((h, passage), [0, None])
        got[0] += 1
        if got[0] == 1:
            got[1] = place
            return
        if got[1] is not None:
            self.known.append(got[1])
            got[1] = None
        self.known.append(place)

    def _merged(self) -> list[list]:
        """Known places, those of one document that touch made into one."""
        out: list[list] = []
        for k1, k2, a, b in sorted(self.known):
            if out and out[-1][:2] == [k1, k2] and a <= out[-1][3]:
                out[-1][3] = max(out[-1][3], b)
            else:
                out.append([k1, k2, a, b])
        return out

    def rows(self) -> Iterator[pa.RecordBatch]:
        out = [(h, p, min(n, 2), *(place or (None,) * 4)) for (h, p), (n, place) in self.seen.items()]
        out += [(hash(tuple(place)), None, 0, *place) for place in self._merged()]
        self.seen, self.known = {}, []
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10_000], strict=True), _PASSAGE.types, strict=True)], schema=_PASSAGE)


def _passages(suspects: DataFrame, window: int) -> DataFrame:
    """(h, passage, n, k1, k2, a, b): passages under repeated anchors; without passage, a span known to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, fold = Hashes(), _Fold()
        for b in batches:
            for k1, k2, x, flags in zip(*(_values(b.column(c)) for c in ("k1", "k2", "text", "flags")), strict=True):
                words = _tokens(x)
                place, run_hash = anchors(words, hashes, window)
                if not len(place):
                    continue
                hot = {f["place"]: f["hot"] for f in flags}
                cuts = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1, [len(place)]])
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    p = int(place[s])
                    if p not in hot:
                        continue
                    if hot[p]:
                        for i in range(s, e):
                            one = b" ".join(words[i : i + window])
                            fold.add(int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little", signed=True), one, (k1, k2, i, i + window))
                    else:
                        fold.add(int(run_hash[p].view(np.int64)), b" ".join(words[s : e - 1 + window]), (k1, k2, s, e - 1 + window))
                if len(fold.seen) + len(fold.known) > FOLD:
                    yield from fold.rows()
        yield from fold.rows()

    return suspects.mapInArrow(run, "h long, passage binary, n int, k1 long, k2 long, a int, b int")


def _spans(passages: DataFrame, window: int) -> DataFrame:
    """(k1, k2, a, b): spans of words to remove, from the automata of each shard."""

    def solved(shard: dict[bytes, list]) -> Iterator[tuple]:
        automaton = SuffixAutomaton()
        split = {p: p.split(b" ") for p in shard}
        for p, (n, _) in shard.items():
            automaton.add(split[p], n)
        automaton.close()
        for p, (_, places) in shard.items():
            if not places:
                continue
            starts = automaton.repeats(split[p], window)
            runs: list[list[int]] = []
            for s in starts:
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = s + window
                else:
                    runs.append([s, s + window])
            for k1, k2, a in places:
                for s, e in runs:
                    yield k1, k2, a + s, a + e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[bytes, list] = {}
        group: dict[bytes, list] = {}
        size, now, out = 0, None, []

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["k1", "k2", "a", "b"])

        def close_group() -> int:
            # an anchor that brings a single occurrence here has no repeated window
            alone = len(group) == 1 and next(iter(group.values()))[0] == 1
            n = 0 if alone else sum(p.count(b" ") + 1 for p in group)
            if not alone:
                shard.update(group)
            group.clear()
            return n

        for b in batches:
            for h, p, n, k1, k2, a, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p is None:
                    out.append((k1, k2, a, e))
                    continue
                if h != now:
                    size += close_group()
                    now = h
                    if size >= SHARD_WORDS:
                        out.extend(solved(shard))
                        shard, size = {}, 0
                got = group.setdefault(p, [0, []])
                got[0] += n
                if k1 is not None:
                    got[1].append((k1, k2, a))
            yield packed()
            out = []
        close_group()
        out.extend(solved(shard))
        yield packed()

    ordered = passages.repartition("h").sortWithinPartitions("h", "passage")
    return ordered.mapInArrow(run, "k1 long, k2 long, a int, b int")


def _with_spans(docs: DataFrame, text: str, doc_id: str, window: int, extra: list[str]) -> DataFrame:
    """``extra`` columns as x_0, x_1, ..., k1, k2, text and spans (array of (a, b), null: none) of every document."""
    k1, k2 = _keyed(docs, text, doc_id)
    slim = docs.select(k1, k2, F.col(text).cast("string").alias("text"))
    found = materialize(_anchor_rows(slim, window), "substring-anchors")
    counts = found.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    again = materialize(counts.where("n > 1").select("h", (F.col("n") > HOT).alias("hot")), "substring-repeated")
    each = found.select("rid", F.explode(F.arrays_zip("place", "h")).alias("x")).select("rid", "x.place", "x.h")
    flags = each.join(again, "h").groupBy("rid").agg(F.collect_list(F.struct("place", "hot")).alias("flags"))
    # rows that repeat a document have the same flags
    flags = flags.join(found.select("rid", "k1", "k2"), "rid").groupBy("k1", "k2").agg(F.first("flags").alias("flags"))
    flags = materialize(flags, "substring-flags")
    discard(found, again)
    # of both joins, only texts that may have a match are shuffled
    suspects = split(slim, key_filter(flags, "k1", "k2"), "k1", "k2")[0].join(flags, ["k1", "k2"])
    spans = _spans(_passages(suspects, window), window)
    spans = materialize(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "substring-spans")
    whole = docs.select(*[F.col(f"`{c}`").alias(f"x_{i}") for i, c in enumerate(extra)], k1, k2, F.col(text).cast("string").alias("text"))
    some, none = split(whole, key_filter(spans, "k1", "k2"), "k1", "k2")
    return some.join(spans, ["k1", "k2"], "left").unionByName(none.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))


def kept_words(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    """The words outside all spans."""
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["a"] for s in spans], 1)
    np.add.at(edge, [s["b"] for s in spans], -1)
    return [words[i] for i in np.nonzero(np.cumsum(edge[:-1]) == 0)[0].tolist()]


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            total, gone, digest = [], [], []
            for x, s in zip(_values(b.column("text")), _values(b.column("spans")), strict=True):
                words = _tokens(x)
                kept = kept_words(words, s)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("x_0"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    whole = _with_spans(docs, text, doc_id, window, [doc_id]).select("x_0", "text", "spans")
    return whole.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated spans cut out of the text; a text that loses words has the others joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = [x if not s else b" ".join(kept_words(_tokens(x), s)).decode("utf-8", "surrogatepass") for x, s in zip(_values(b.column("text")), _values(b.column("spans")), strict=True)]
            own = [c for c in b.schema.names if c.startswith("x_")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(out, pa.string())], [*own, "text"])

    extra = [c for c in docs.columns if c != text]
    whole = _with_spans(docs, text, doc_id, window, extra)
    kinds = ", ".join(f"x_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    cut = whole.select(*[f"x_{i}" for i in range(len(extra))], "text", "spans").mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string")
    out = {c: F.col(f"x_{i}") for i, c in enumerate(extra)} | {text: F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[out[c].alias(c) for c in docs.columns])
