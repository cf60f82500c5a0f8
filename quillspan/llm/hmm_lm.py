"""LM scoring with a hidden Markov model.

Tokens are a text's words (A-Z lower-cased), then one end. Each token belongs to an emission class: words
that make up at least a ``CLASS_SHARE``-th of the training tokens are classes of their own (so there are at most
that many), all others fall into ``SUFFIX_CLASSES`` classes by their last bytes. A state emits a class; the
word's part within its class comes from corpus counts, (c+1)/(n+v+1) with n tokens and v words in the class,
one more word standing for all unseen ones. So the states' parameters have a fixed size, while every word
of the corpus keeps its own count, however large the vocabulary gets.

Training: word counts over all training rows (counted in each task, then summed by word); a start for the
states from the corpus' class shares, seeded unevenly; then Baum-Welch rounds over all training rows until a
round gains next to nothing (``SETTLED``), each task adding up expected counts and the sums meeting by class.
The rows' classes are written once. Scoring: the scaled forward
recursion gives the likelihood of every whole text, with no cut. Counts of frequent words (at most
``COMMON``) are sent to the tasks; those of the others reach the texts by a join on the word.

Defined results: a null or empty text is its end token alone; a null id is in training (its rest is not 2)
and scored like others; repeated rows each count and each give a row; without training rows all counts are
0 and states are uniform; an empty table gives an empty table; a text above ``PART`` tokens is trained on in parts that hand
on their odds, which gives the counts of the whole in bounded memory; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quillspan.sources.scratch import materialize

#: At most so many rounds; training ends once a round gains less than so many log10 units a token over the one before.
STATES, ROUNDS, SETTLED = 8, 14, 1e-3
CLASS_SHARE, SUFFIX_CLASSES, SUFFIX_BYTES = 8192, 8192, 4
COMMON = 1 << 18
HELD_MOD, HELD_AT = 7, 2
#: Texts of up to so many tokens are handled together, so many tokens at once.
BATCHES = ((512, 250_000), (2048, 500_000), (float("inf"), 1_000_000))
#: Tokens above which a text is trained on part by part; words counted before they are sent on.
PART, FLUSH = 100_000, 300_000
#: Steps between two scalings; rows of a slice that stays in cache.
RESCALE, SLICE = 4, 1 << 15
#: Least emission of a state, of the states' mean for that class.
FLOOR = 1e-6
#: Weight of the corpus' class shares in a state's emissions, and of even moves in its transitions.
EMISSION_PRIOR, MOVE_PRIOR = 500.0, 5.0
END = 0


def tokens(text: str | bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; the end token is not among them."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.lower().split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_MOD == HELD_AT, F.lit(False))


def _crc_table() -> np.ndarray:
    """The bytewise table of CRC-32 (reflected, as ``zlib.crc32`` and Spark's ``crc32`` have it)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


class Classes:
    """Emission classes: 0 is the end, then the frequent words, then classes by the CRC-32 of the last bytes.

    ``common`` words (the frequent ones among them) have places of their own, the end is place 0."""

    def __init__(self, frequent: list[bytes], common: Iterable[bytes] = ()):
        self.first = len(frequent) + 1
        seen = set(frequent)
        rest = [w for w in common if w not in seen]
        self.common = [*frequent, *rest]
        self.table = _crc_table()
        self.place = {w: i for i, w in enumerate([b"", *self.common])}
        self.of_place = np.concatenate([np.arange(self.first), self._suffixes(rest)]).astype(np.int32)

    @property
    def size(self) -> int:
        return self.first + SUFFIX_CLASSES

    def _suffixes(self, words: list[bytes]) -> np.ndarray:
        n = np.minimum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), SUFFIX_BYTES)
        tails = np.array([w[-SUFFIX_BYTES:] for w in words], dtype=f"S{SUFFIX_BYTES}").view(np.uint8).reshape(len(words), SUFFIX_BYTES)
        crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
        for j in range(SUFFIX_BYTES):
            crc = np.where(j < n, self.table[(crc ^ tails[:, j]) & 0xFF] ^ (crc >> 8), crc)
        return self.first + (~crc % np.uint32(SUFFIX_CLASSES)).astype(np.int32)

    def flat(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Of all tokens of some texts, one after the other, each text with its end: classes and places (-1: none);
        where each text starts, and a closing place; the words without a place, and which tokens they are."""
        starts = np.cumsum([0, *(len(w) + 1 for w in texts)])
        words = [x for w in texts for x in (*w, b"")]
        place = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        out = self.of_place.take(place, mode="wrap")
        seldom = np.nonzero(place < 0)[0]
        rest = [words[i] for i in seldom.tolist()]
        out[seldom] = self._suffixes(rest)
        return out, place, starts, rest, seldom

    def of(self, words: list[bytes]) -> np.ndarray:
        """The classes of a text: its words, then the end."""
        return self.flat([words])[0]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of some texts) through a column of texts, ``SLICE`` tokens or one text at a time."""
    held, n, first = [], 0, 0
    for i, x in enumerate(column):
        held.append(tokens(x.as_py()))
        n += len(held[-1])
        if n >= SLICE:
            yield first, held
            held, n, first = [], 0, i + 1
    if held:
        yield first, held


class Waiting:
    """Sequences held until there are enough of about one length: a batch takes as many steps as its longest has tokens."""

    def __init__(self):
        self.held: list[list] = [[] for _ in BATCHES]
        self.n = [0] * len(BATCHES)

    def add(self, tokens: int, item) -> list | None:
        """Takes ``item``; gives a batch that is full now."""
        i = next(i for i, (longest, _) in enumerate(BATCHES) if tokens <= longest)
        self.held[i].append(item)
        self.n[i] += tokens
        if self.n[i] < BATCHES[i][1]:
            return None
        full, self.held[i], self.n[i] = self.held[i], [], 0
        return full

    def rest(self) -> list[list]:
        return [h for h in self.held if h]


@dataclass
class Model:
    start: np.ndarray  #: (states,)
    move: np.ndarray  #: (states, states)
    emit: np.ndarray  #: (classes, states)


class Batch:
    """Sequences laid out by time: all first tokens, all second tokens, ..., longest sequence first."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths = lengths[self.order]
        self.alpha = self.scale = None
        self.active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(len(rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.rank = np.empty(len(rank), np.int32)
        self.obs = np.empty(len(rank), np.int32)
        where = self.at[time] + rank
        self.obs[where] = np.concatenate([sequences[i] for i in self.order])
        self.rank[where] = rank


def log10_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of classes, by the scaled forward recursion in doubles."""
    b = Batch(sequences)
    out = np.zeros(len(sequences))
    at, ones = b.at.tolist(), np.ones((len(model.start), 1))
    a = np.repeat(model.start[None], at[1], axis=0)
    for t in range(len(at) - 1):
        low, high = at[t], at[t + 1]
        if t:
            if high - low < len(a):
                out[high - low : len(a)] += np.log10(a[high - low :].sum(axis=1))
            a = a[: high - low] @ model.move
        a *= model.emit.take(b.obs[low:high], axis=0)
        if t % RESCALE == 0:
            c = a @ ones
            a /= c
            out[: high - low] += np.log10(c[:, 0])
    out[: len(a)] += np.log10(a.sum(axis=1))
    ordered = np.empty(len(sequences))
    ordered[b.order] = out
    return ordered


def _forward(b: Batch, e: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha of every token, and what each row was divided by; ``first``: the states' odds before the first tokens.

    Rows are scaled at every ``RESCALE``-th step; ``FLOOR`` keeps what happens in between far from underflow."""
    at, ones = b.at.tolist(), np.ones((move.shape[0], 1), np.float32)
    alpha, scale = np.empty_like(e), np.ones(len(e), np.float32)
    for t in range(len(at) - 1):
        low, high = at[t], at[t + 1]
        a = alpha[low:high]
        if t:
            np.dot(alpha[at[t - 1] : at[t - 1] + high - low], move, out=a)
            np.multiply(a, e[low:high], out=a)
        else:
            np.multiply(first, e[low:high], out=a)
        if t % RESCALE == 0:
            c = a @ ones
            a /= c
            scale[low:high] = c[:, 0]
    return alpha, scale


def _backward(b: Batch, e: np.ndarray, last: np.ndarray | None, move: np.ndarray) -> np.ndarray:
    """beta of every token, up to a factor a row; ``e`` becomes e * beta, but for first tokens. ``last``: beta of
    the last token, where a single sequence goes on beyond it."""
    at, ones = b.at.tolist(), np.ones((move.shape[0], 1), np.float32)
    beta, back = np.ones_like(e), np.ascontiguousarray(move.T)
    if last is not None:
        beta[-1] = last
    for t in range(len(at) - 2, 0, -1):
        low, high = at[t], at[t + 1]
        x, y = e[low:high], beta[at[t - 1] : at[t - 1] + high - low]
        np.multiply(x, beta[low:high], out=x)
        np.dot(x, back, out=y)
        if t % RESCALE == 0:
            y /= y @ ones
    return beta


class Expected:
    """Baum-Welch counts and the log10 likelihood, under one model, of the sequences added."""

    def __init__(self, model: Model):
        mean, k = model.emit.mean(axis=1, keepdims=True), len(model.start)
        self.model, self.log_mean = model, np.log10(mean[:, 0])
        self.first, self.move, self.emit = model.start.astype(np.float32), model.move.astype(np.float32), (model.emit / mean).astype(np.float32)
        self.start, self.moves, self.emits, self.log10 = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k)), 0.0

    def add(self, sequences: list[np.ndarray]) -> None:
        """Sequences that are held at once."""
        b = Batch(sequences)
        self.start += self._solve(b, self.first, None)[0].sum(axis=0, dtype=np.float64)
        self._likelihood(b, self.first)

    def add_long(self, sequence: np.ndarray) -> None:
        """One sequence of any length, in parts of ``PART``: forward for the odds at their ends, then solved from the last part to the first."""
        parts = [sequence[at : at + PART] for at in range(0, len(sequence), PART)]
        ends: list[np.ndarray] = []
        for part in parts:
            ends.append(self._likelihood(Batch([part]), ends[-1] @ self.move if ends else self.first))
        last = None
        for i in range(len(parts) - 1, -1, -1):
            gamma, x = self._solve(Batch([parts[i]]), ends[i - 1] @ self.move if i else self.first, last)
            if i:  # the move over the border to the part before
                over = np.outer(ends[i - 1], x).astype(np.float64) * self.model.move
                self.moves += over / over.sum()
                last = self.move @ x
                last /= last.sum()
            else:
                self.start += gamma[0]

    def _likelihood(self, b: Batch, first: np.ndarray) -> np.ndarray:
        """Adds the likelihood, where ``_solve`` has not; the odds of the states at the end of the last sequence in order."""
        if b.alpha is None:
            b.alpha, b.scale = _forward(b, self.emit.take(b.obs, axis=0), first, self.move)
        ends = b.at[b.lengths - 1] + np.arange(len(b.lengths))
        tail = b.alpha[ends]
        self.log10 += float(np.log10(b.scale, dtype=np.float64).sum() + np.log10(tail.sum(axis=1, dtype=np.float64)).sum() + self.log_mean.take(b.obs).sum())
        b.alpha = b.scale = None
        return tail[-1] / tail[-1].sum()

    def _solve(self, b: Batch, first: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Adds moves and emissions; the odds of the first tokens' states, and e * beta of the very first token."""
        e = self.emit.take(b.obs, axis=0)
        alpha, scale = _forward(b, e, first, self.move)
        b.alpha, b.scale = alpha, scale
        beta = _backward(b, e, last, self.move)
        at_first = e[0] * beta[0]
        np.multiply(alpha, beta, out=beta)
        z = beta @ np.ones((beta.shape[1], 1), np.float32)
        beta /= z
        e /= z * scale[:, None]
        n = b.at[1]
        earlier = np.arange(n, len(b.obs)) - np.repeat(b.active[:-1], b.active[1:])
        moves = np.zeros_like(self.moves)
        for at in range(0, len(earlier), SLICE):
            i = earlier[at : at + SLICE]
            moves += alpha.take(i, axis=0).T @ e[n + at : n + at + len(i)]
        self.moves += moves * self.model.move
        for k in range(beta.shape[1]):
            self.emits[:, k] += np.bincount(b.obs, beta[:, k], len(self.emits))
        return beta[:n], at_first


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (start, move, emit) of some sequences."""
    out = Expected(model)
    short = [s for s in sequences if len(s) <= PART]
    if short:
        out.add(short)
    for s in sequences:
        if len(s) > PART:
            out.add_long(s)
    return out.start, out.moves, out.emits


def maximized(start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
    """The model of expected counts; ``share``: the corpus' share of each class."""
    k = len(start)
    emit = emit + EMISSION_PRIOR * share[:, None]
    move = move + MOVE_PRIOR / k
    start = start + 1.0
    emit = emit / emit.sum(axis=0)
    emit = np.maximum(emit, FLOOR * emit.mean(axis=1, keepdims=True))
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _seeded(share: np.ndarray, states: int) -> Model:
    """The start: uneven emissions around the corpus' class shares, and sticky moves."""
    rng = np.random.default_rng(7)
    emit = share[:, None] * rng.gamma(1.0, size=(len(share), states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


@dataclass
class Trained:
    """What scoring needs: the model, its classes, and counts; ``counts`` is the table (word, c) of all words."""

    model: Model
    frequent: list[bytes]
    common: dict[bytes, int]
    class_size: np.ndarray
    tokens: int
    distinct: int
    ends: int
    counts: DataFrame


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), held_out(F.col(doc_id)).alias("held_out"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the texts of ``rows``; each task adds up what it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for x in b.column("text"):
                found.update(tokens(x.as_py()))
                if len(found) > FLUSH:
                    yield out()
                    found.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _classed(rows: DataFrame, frequent: list[bytes], common: dict[bytes, int]) -> DataFrame:
    """(c): the classes of every text of ``rows``, as 16-bit numbers."""
    sent = rows.sparkSession.sparkContext.broadcast((frequent, list(common)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(*sent.value)
        for b in batches:
            for _, texts in _slices(b.column("text")):
                own, _, starts, _, _ = classes.flat(texts)
                raw, at = own.astype("<u2"), starts.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([raw[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], ["c"])

    return rows.select("text").mapInArrow(run, "c binary")


def _round(parts: DataFrame, sent, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, move, emit) and log10 likelihood over all of ``parts``, summed across partitions by class."""
    names = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Expected(sent.value)
        waiting = Waiting()
        for b in batches:
            for x in b.column("c"):
                s = np.frombuffer(x.as_buffer(), "<u2").astype(np.int32)
                if len(s) > PART:
                    total.add_long(s)
                elif full := waiting.add(len(s), s):
                    total.add(full)
        for held in waiting.rest():
            total.add(held)
        every = np.concatenate([total.emits, total.moves, total.start[None], np.full((1, states), total.log10)])
        at = np.nonzero(every.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(every[at, k]) for k in range(states))], ["row", *names])

    sums = parts.mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    size = len(sent.value.emit)
    total = np.zeros((size + states + 2, states))
    total[sums.column("row").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], axis=1)
    return total[size + states], total[size : size + states], total[:size], float(total[-1, 0])


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", states: int = STATES, rounds: int = ROUNDS) -> Trained:
    spark = docs.sparkSession
    rows = _texts(docs, text, doc_id).where(~F.col("held_out"))
    counts = materialize(word_counts(rows), "hmm-words")
    ends = rows.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    known = counts.where(F.col("c") * COMMON >= n).toArrow()
    common = {w.encode(): c for w, c in zip(known.column("word").to_pylist(), known.column("c").to_pylist(), strict=True)}
    frequent = sorted(w for w, c in common.items() if c * CLASS_SHARE >= n)
    classes = Classes(frequent)
    suffix = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), -SUFFIX_BYTES, SUFFIX_BYTES)), F.lit(SUFFIX_CLASSES)).cast("int")
    rest = counts.where(~(F.col("c") * CLASS_SHARE >= n)).groupBy(suffix.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    size = np.ones(classes.size)
    size[END] += ends + 1
    size[1 : classes.first] += [common[w] + 1 for w in frequent]
    size[classes.first + rest.column("k").to_numpy()] += rest.column("n").to_numpy() + rest.column("v").to_numpy()
    share = size / size.sum()
    model = _seeded(share, states)
    parts = materialize(_classed(rows, frequent, common), "hmm-classes")
    before = -np.inf
    for _ in range(rounds if ends else 0):
        sent = spark.sparkContext.broadcast(model)
        *found, log = _round(parts, sent, states)
        sent.unpersist()
        model = maximized(*found, share)
        if log - before < SETTLED * n:
            break
        before = log
    return Trained(model, frequent, common, size, n, v, ends, counts)


def score(docs: DataFrame, trained: Trained, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((trained.model, trained.frequent, trained.common, np.log10(trained.class_size)))
    total, ends = float(np.log10(trained.tokens + trained.distinct + 1)), trained.ends
    rows = _texts(docs, text, doc_id)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent, common, class_log = sent.value
        classes = Classes(frequent, common)
        place_log = np.log10(np.array([ends, *(common[w] for w in classes.common), 0], dtype=np.float64) + 1)  # the last: no place
        first = TaskContext.get().partitionId() << 40

        def out(held: list) -> pa.RecordBatch:
            nonlocal first
            own, ids, apart, known, log, in_class, rare = zip(*held, strict=True)
            count = np.array([len(x) for x in own])
            path = log10_likelihood(model, list(own))
            seldom = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)], dtype=np.int32)), pa.array([w for r in rare for w in r], pa.binary()))
            rid = pa.array(range(first, first + len(own)), pa.int64())
            first += len(own)
            cols = [rid, pa.array(ids, id_type), pa.array(apart), pa.array(count, pa.int64()), pa.array(known, pa.int64()), pa.array(np.array(log) - total * count), pa.array(path + np.array(log) - np.array(in_class)), seldom]
            return pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "path", "rare"])

        waiting, id_type = Waiting(), pa.null()
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for at, texts in _slices(b.column("text")):
                own, place, starts, rest, seldom = classes.flat(texts)
                log, in_class = np.add.reduceat(place_log.take(place, mode="wrap"), starts[:-1]).tolist(), np.add.reduceat(class_log.take(own), starts[:-1]).tolist()
                of_rest = np.searchsorted(seldom, starts).tolist()
                ids, apart = b.column("doc_id").slice(at, len(texts)).to_pylist(), b.column("held_out").slice(at, len(texts)).to_pylist()
                starts = starts.tolist()
                for k in range(len(texts)):
                    n, few = starts[k + 1] - starts[k], rest[of_rest[k] : of_rest[k + 1]]
                    if full := waiting.add(n, (own[starts[k] : starts[k + 1]], ids[k], apart[k], n - len(few) - (ends == 0), log[k], in_class[k], few)):
                        yield out(full)
        for held in waiting.rest():
            yield out(held)

    parts = materialize(rows.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, path double, rare array<binary>"), "hmm-scores")
    sent.unpersist()
    # log10(c+1) of the words that were not sent along; unseen words add log10(1)
    rest = parts.select("rid", F.explode("rare").alias("w")).select("rid", F.col("w").cast("string").alias("word")).join(trained.counts.where(F.col("c") * COMMON < trained.tokens), "word")
    rest = rest.groupBy("rid").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("c") + 1)).alias("log"))
    out = parts.drop("rare").join(rest, "rid", "left")
    more = F.coalesce("log", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(trained.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("path") + more).alias("score"))
