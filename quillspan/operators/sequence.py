"""Linear-chain models of token tags: hashed features, training over a table, transitions for given emissions, tagging.

A document is a row of token features, each a slot of a table of fixed size. One evaluation of the likelihood is one job:
tasks work through their documents in batches of bounded size (emissions by gathering slots, expected tags and moves by
the recursions of ``chain``), add up their derivative in an array of the model's size, and send the slots that they met;
Spark adds these by slot. The driver holds the model and a bounded number of earlier steps, never documents.

A task's sums are sent once, at its end, so a lost executor repeats tasks and nothing is counted twice. Documents without
tokens take no part; a null text has none. A gold span that does not lie on token borders is left out and counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspan.operators import candidates, chain, features, optim
from quillspan.sources.scratch import discard, materialize

#: Tokens whose features are held at once.
TOKENS = 1 << 17
#: Training ends once a round gains less than this part of the loss.
GAIN = 1e-5
#: Charges on absolute and squared weights, and how often a slot must occur.
L1, L2, LEAST = 0.1, 0.1, 2


#: The features of a token by name, and which of them follow from the same word (its own, a neighbour's) or from flags.
OWN = ("bias", "w", "shape", "len", "upper", "title", "digit", *(f"{kind}{n}" for kind in ("pre", "suf") for n in (2, 3, 4)))
REACH, JOINS = (-2, -1, 1, 2), ("left_joined", "right_joined", "left_newline", "right_newline")
NAMES = (*OWN[:7], *JOINS[:2], *OWN[7:], *(f"w{d:+d}" for d in REACH), *(f"s{d:+d}" for d in REACH), *JOINS[2:])
GROUPS = tuple(tuple(NAMES.index(n) for n in names) for names in (OWN, *((f"w{d:+d}", f"s{d:+d}") for d in REACH), JOINS))


def token_slots(docs: DataFrame, bits: int = 16, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, starts, ends, slots): each document's token bounds, and the slots of all tokens' features one after the
    other, the same number for each token (-1: it has no such feature). Columns in ``keep`` come along.

    Features are made once for each distinct word of a stretch of texts; its tokens take theirs by place."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep)
    kinds = {n: slim.schema[n].dataType.simpleString() for n in ("doc_id", *keep)}
    rule = re.compile(candidates.TOKEN)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the distinct words of a stretch, a row each, then a row without a word that has the stretch's documents
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            for part in candidates._stretches(texts):
                own = texts[part]
                spans = [[m.span() for m in rule.finditer(t)] for t in own]
                n = np.array([len(x) for x in spans], np.int32)
                bounds = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
                found = pa.array([t[x:y] for t, s in zip(own, spans, strict=True) for x, y in s], pa.string()).dictionary_encode()
                first = np.repeat(np.cumsum(n) - n, n)
                i, last = np.arange(len(bounds)) - first, np.arange(len(bounds)) == first + np.repeat(n, n) - 1
                touch = np.append(bounds[1:, 0] == bounds[:-1, 1], False) if len(bounds) else np.zeros(0, bool)
                left = np.where(i == 0, bounds[:, 0] == 0, np.append(False, touch[:-1])[: len(i)])
                gaps = [candidates._broken(t, np.array(s, np.int64).reshape(-1, 2)) for t, s in zip(own, spans, strict=True)]
                flags = np.stack([left, touch & ~last, *(np.concatenate([g[x] for g in gaps]) for x in (slice(None, -1), slice(1, None)))]).astype(np.int32)
                tokens = np.concatenate([bounds.T, found.indices.to_numpy()[None].astype(np.int32), flags])
                many = len(found.dictionary)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), b.column(c).slice(part.start, len(own))) for c in kinds]
                held = [pa.array([n.tobytes()]), pa.array([tokens.tobytes()]), *lists]
                names = ["token", "sizes", "tokens", *kinds]
                if many:
                    yield pa.RecordBatch.from_arrays([found.dictionary, *(pa.nulls(many, x.type) for x in held)], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *held], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[np.ndarray] = []
        for b in batches:
            table = b.column("made").flatten().to_numpy().reshape(b.num_rows, -1)
            at = 0
            for stop in np.flatnonzero(b.column("tokens").is_valid().to_numpy(zero_copy_only=False)):
                # the last row is that of no word
                known = np.concatenate([*tables, table[at : stop + 1]])
                tables, at = [], stop + 1
                n = np.frombuffer(b.column("sizes")[stop].as_py(), np.int32)
                start, end, code, *flags = np.frombuffer(b.column("tokens")[stop].as_py(), np.int32).reshape(7, -1)
                first, size = np.repeat(np.cumsum(n) - n, n), np.repeat(n, n)
                i = np.arange(len(code)) - first
                out = np.empty((len(code), len(NAMES)), np.int32)
                out[:, GROUPS[0]] = known[code, : len(OWN)]
                for g, d in enumerate(REACH):
                    whose = np.where((i + d >= 0) & (i + d < size), np.roll(code, -d), len(known) - 1)
                    out[:, GROUPS[1 + g]] = known[whose, len(OWN) + 2 * g : len(OWN) + 2 * g + 2]
                for g, (column, flag) in enumerate(zip(GROUPS[-1], flags, strict=True)):
                    out[:, column] = known[-1, len(OWN) + 2 * len(REACH) + 2 * g + flag]
                some = np.flatnonzero(n)
                ends = np.append(0, np.cumsum(n[some])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(start)), pa.ListArray.from_arrays(pa.array(ends), pa.array(end)), pa.ListArray.from_arrays(pa.array(ends * len(NAMES)), pa.array(out.ravel()))]
                taken = [b.column(c).slice(stop, 1).flatten().take(pa.array(some)) for c in kinds]
                yield pa.RecordBatch.from_arrays([taken[0], *lists, *taken[1:]], ["doc_id", "starts", "ends", "slots", *keep])
            tables.append(table[at:])

    lists = ", ".join(f"`{n}` array<{k}>" for n, k in kinds.items())
    known = features.word_features(slim.mapInArrow(words, f"token string, sizes binary, tokens binary, {lists}"))
    named: dict[str, Column] = {"bias": F.lit(""), "w": F.col("lower"), "len": F.col("length")}
    slot = lambda name, value: F.when(value.isNull(), -1).otherwise(F.pmod(F.xxhash64(F.lit(name), value.cast("string")), F.lit(1 << bits)).cast("int"))
    near = [x for d in REACH for x in (slot(f"w{d:+d}", F.coalesce(F.concat(F.lit("w="), F.col("lower")), F.lit("edge"))), slot(f"s{d:+d}", F.col("shape")))]
    made = F.array(*[slot(n, named.get(n, F.col(n))) for n in OWN], *near, *[slot(n, F.lit(x)) for n in JOINS for x in (False, True)])
    rest = "".join(f", `{n}` {kinds[n]}" for n in keep)
    return known.select(made.alias("made"), "sizes", "tokens", *kinds).mapInArrow(gather, f"doc_id {kinds['doc_id']}, starts array<int>, ends array<int>, slots array<int>{rest}")


def _spread(df: DataFrame) -> DataFrame:
    """Rows over as many partitions as there are cores, or shuffle partitions if these are more."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_spans(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, text, spans): texts with their spans (start, end, label) in order, dealt over the cores: what is made of them later on,
    tokens and slots, is not shuffled."""
    own = gold.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    return _spread(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(own, "doc_id", "left"))


def training_rows(docs: DataFrame, gold: DataFrame, tags: Sequence[str], bits: int = 16) -> DataFrame:
    """(doc_id, starts, ends, slots, gold, k, unaligned, lost), written once: gold tags as places in ``tags``, of the spans (doc_id,
    start, end, label); lost are the bounds of those that do not lie on token borders, one after the other."""
    place = {t: i for i, t in enumerate(tags)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, k, lost = [], [], []
            for starts, ends, spans in zip(*(b.column(c) for c in ("starts", "ends", "spans")), strict=True):
                held = [(s["start"], s["end"], s["label"]) for s in spans.as_py() or []]
                found, bad = chain.tags_of(list(zip(starts.as_py(), ends.as_py(), strict=True)), held)
                codes.append([place[t] for t in found])
                k.append(len(held) - bad)
                begin, stop = set(starts.as_py()), set(ends.as_py())
                lost.append([x for a, c, _ in held if a not in begin or c not in stop for x in (a, c)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "starts", "ends", "slots")), pa.array(codes, pa.list_(pa.int32())), pa.array(k, pa.int32()), pa.array([len(x) // 2 for x in lost], pa.int32()), pa.array(lost, pa.list_(pa.int32()))], ["doc_id", "starts", "ends", "slots", "gold", "k", "unaligned", "lost"])

    joined = token_slots(with_spans(docs, gold), bits, keep=("spans",))
    kind = joined.schema["doc_id"].dataType.simpleString()
    return materialize(joined.mapInArrow(run, f"doc_id {kind}, starts array<int>, ends array<int>, slots array<int>, gold array<int>, k int, unaligned int, lost array<int>"), "tagged")


@dataclass
class Model:
    tags: tuple[str, ...]
    weights: np.ndarray  #: (slots + 1) x tags; the last row is that of no feature
    move: np.ndarray  #: tags x tags

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        """Of tokens x features slots, tokens x tags."""
        out = np.zeros((len(slots), len(self.tags)))
        for column in slots.T:
            out += self.weights[column]
        return out


def _split(x: np.ndarray, tags: Sequence[str], slots: int) -> Model:
    size = len(tags)
    table = np.zeros((slots + 1, size))
    table[:-1] = x[: slots * size].reshape(slots, size)
    return Model(tuple(tags), table, x[slots * size :].reshape(size, size))


def numbers(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], size: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Documents, some ``size`` values of their last column at once."""
    held, many = [], 0
    for b in batches:
        for row in zip(*(numbers(b.column(n)) for n in names), strict=True):
            held.append(row)
            many += len(row[-1])
            if many >= size:
                yield held
                held, many = [], 0
    if held:
        yield held


def by_slot(total: np.ndarray, slots: np.ndarray, rows: np.ndarray) -> None:
    """Add to each slot the rows of the tokens that have it; -1 goes to the last row, which is not used."""
    flat = slots.ravel()
    order = np.argsort(flat)
    kinds = flat[order]
    first = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
    total[kinds[first]] += np.add.reduceat(rows[order // slots.shape[1]], first, axis=0)


#: Rows of a sum that travel together.
STRETCH = 1 << 12


def summed(rows: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], width: int, size: int) -> np.ndarray:
    """The sum over all tasks of the rows (key, values) that ``kernel`` makes, as a table of ``size`` rows.

    A task adds up its own rows and sends the stretches of the table that it met, as bytes; each stretch is added up where it meets
    the same one of other tasks. There are no more tasks than cores, so what is sent does not grow with the rows."""
    spark = rows.sparkSession
    kinds = pa.schema([("part", pa.int32()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for keys, values in kernel(batches):
            total[keys] += values
        for part in range(0, size, STRETCH):
            if (own := total[part : part + STRETCH]).any():
                yield pa.RecordBatch.from_pylist([{"part": part, "values": own.tobytes()}], kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, values in zip(b.column("part").to_pylist(), b.column("values"), strict=True):
                own = np.frombuffer(values.as_buffer(), np.float64)
                totals[part] = totals[part] + own if part in totals else own.copy()
        for part, own in totals.items():
            yield pa.RecordBatch.from_pylist([{"part": part, "values": own.tobytes()}], kinds)

    cores = spark.sparkContext.defaultParallelism
    made = rows.coalesce(cores).mapInArrow(run, "part int, values binary")
    got = made.repartition(min(cores, -(-size // STRETCH)), "part").mapInArrow(add, "part int, values binary").toArrow()
    out = np.zeros((size, width))
    for part, values in zip(got.column("part").to_pylist(), got.column("values").to_pylist(), strict=True):
        out[part : part + STRETCH] = np.frombuffer(values).reshape(-1, width)
    return out


def _codes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place among the distinct rows, and the distinct rows; exact, a column after the other."""
    code = np.zeros(len(table), np.int64)
    for column in table.T:
        kinds, own = np.unique(column, return_inverse=True)
        if len(kinds) > 1:
            code = np.unique(code * len(kinds) + own, return_inverse=True)[1]
    first = np.empty(int(code.max()) + 1, np.int64)
    first[code] = np.arange(len(code))
    return code, table[first]


def group_codes(slots: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and distinct rows of the features that follow from one word or from flags; of each feature if their order is not known."""
    groups = GROUPS if slots.shape[1] == len(NAMES) else [(c,) for c in range(slots.shape[1])]
    return [_codes(slots[:, list(g)]) for g in groups]


def blocks(rows: DataFrame, values: str = "slots") -> DataFrame:
    """(sizes, gold, codes, tables), written once: some ``TOKENS`` tokens in a row, as bytes. Features that follow from the same word
    or flags are one code; its distinct slots stand once in a table of the block. With other ``values`` a token's are one code."""
    # no more tasks than cores, so that blocks are full
    slim = rows.where(F.size("gold") > 0).select(values, "gold").coalesce(rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, [values, "gold"], TOKENS):
            table = np.concatenate([s.reshape(len(g), -1) for s, g in held])
            if values == "slots":
                made = group_codes(table)
            else:
                made = [_codes(table)]
            row = {"sizes": np.array([len(g) for _, g in held], np.int32).tobytes(), "gold": np.concatenate([g for _, g in held]).astype(np.int32).tobytes()}
            row |= {"codes": [c.astype(np.int32).tobytes() for c, _ in made], "tables": [t.tobytes() for _, t in made]}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("sizes", pa.binary()), ("gold", pa.binary()), ("codes", pa.list_(pa.binary())), ("tables", pa.list_(pa.binary()))]))

    return materialize(slim.mapInArrow(run, "sizes binary, gold binary, codes array<binary>, tables array<binary>"), "blocks")


def _blocks(batches: Iterator[pa.RecordBatch], kind: type = np.int32) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    numbers_of = lambda x, kind=np.int32: np.frombuffer(x.as_py(), kind)
    for b in batches:
        for sizes, gold, codes, tables in zip(*(b.column(c) for c in ("sizes", "gold", "codes", "tables")), strict=True):
            made = [numbers_of(c) for c in codes]
            yield numbers_of(sizes), numbers_of(gold).astype(np.int64), made, [numbers_of(t, kind).reshape(int(c.max()) + 1, -1) for c, t in zip(made, tables, strict=True)]


def by_code(code: np.ndarray, many: int, rows: np.ndarray) -> np.ndarray:
    """The sum of the rows of each code; every one of the ``many`` occurs."""
    order, each = np.argsort(code.astype(np.uint16) if many <= 1 << 16 else code, kind="stable"), np.bincount(code, minlength=many)
    return np.add.reduceat(rows[order], np.cumsum(each) - each, axis=0)


def evaluation(rows: DataFrame, tags: Sequence[str], slots: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The negative log likelihood of the rows' gold tags and its gradient, as a function of slot weights and moves. ``rows``: those of
    ``training_rows`` or their ``blocks``."""
    size, spark = len(tags), rows.sparkSession
    slim = rows if "codes" in rows.columns else blocks(rows)

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(x)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            model, total = _split(sent.value, tags, slots), np.zeros((slots + size + 2, size))
            for sizes, gold, codes, tables in _blocks(batches):
                scores = sum(model.emissions(t)[c] for c, t in zip(codes, tables, strict=True))
                loss, by_emission, by_move = chain.sums(scores, sizes, gold, model.move, tags)
                for c, t in zip(codes, tables, strict=True):
                    by_slot(total, t, by_code(c, len(t), by_emission))
                total[slots : slots + size] += by_move
                total[slots + size, 0] += loss
            # the row of -1 is the last, after the loss: it is left out
            met = np.flatnonzero(total[:-1].any(axis=1))
            yield met, total[met]

        got = summed(slim, kernel, size, slots + size + 1)
        sent.destroy()
        return float(got[-1, 0]), got[:-1].ravel()

    return at


def slot_counts(rows: DataFrame, slots: int) -> np.ndarray:
    """How often each slot occurs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        total = np.zeros(slots + 1)
        for b in batches:
            total += np.bincount(b.column("slots").flatten().to_numpy(zero_copy_only=False) + 1, minlength=slots + 1)
        met = np.flatnonzero(total[1:])
        yield met, total[1:][met][:, None]

    return summed(rows.select("slots"), kernel, 1, slots)[:, 0].astype(np.int64)


def train(rows: DataFrame, tags: Sequence[str], bits: int = 16, rounds: int = 60, l1: float = L1, l2: float = L2, least: int = LEAST) -> tuple[Model, list[optim.Round]]:
    """A model of the rows' gold tags by penalised likelihood, and what each round came to. Slots below ``least`` stay 0."""
    slots, size = 1 << bits, len(tags)
    free = np.concatenate([np.repeat(slot_counts(rows, slots) >= least, size), chain.legal(tags).ravel()])
    packed = blocks(rows)
    likelihood = evaluation(packed, tags, slots)

    def charged(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = likelihood(x)
        return loss + l2 * float(x @ x), np.where(free, gradient + 2 * l2 * x, 0.0)

    x, log = optim.minimise(charged, np.zeros(len(free)), rounds, l1=l1, gain=GAIN)
    discard(packed)
    return _split(x, tags, slots), log


def emissions(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with the column emission: the scores of all tags, token after token."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sent.value.emissions(s.reshape(n, -1) if n else s.reshape(0, 1)).ravel() for s, n in zip(numbers(b.column("slots")), b.column("starts").value_lengths().to_pylist(), strict=True)]
            ends = pa.array(np.cumsum([0, *map(len, made)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made)))], [*b.schema.names, "emission"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, emission array<double>")


def fit_transitions(rows: DataFrame, tags: Sequence[str], rounds: int = 60, l2: float = 0.0, gain: float = GAIN) -> tuple[np.ndarray, list[optim.Round]]:
    """The table of moves that makes the gold tags of ``rows`` (emission, gold) likeliest, the emissions as they are."""
    size, spark, ok = len(tags), rows.sparkSession, chain.legal(tags)
    packed = blocks(rows, "emission")

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            total = np.zeros((size + 1, size))
            for sizes, gold, (code,), (table,) in _blocks(batches, np.float64):
                loss, _, by_move = chain.sums(table[code], sizes, gold, x.reshape(size, size), tags)
                total[:-1] += by_move
                total[-1, 0] += loss
            yield np.arange(size + 1), total

        got = summed(packed, kernel, size, size + 1)
        return float(got[-1, 0]) + l2 * float(x @ x), np.where(ok.ravel(), got[:-1].ravel() + 2 * l2 * x, 0.0)

    x, log = optim.minimise(at, np.zeros(size * size), rounds, gain=gain)
    discard(packed)
    return x.reshape(size, size), log


def tagged(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, tokens, k, unaligned, nll (of the gold tags), and for the best sequence ("raw") and the best with k spans
    ("exact") the spans and how many of them are gold."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = {n: [] for n in ("tokens", "nll", "raw", "raw_right", "exact", "exact_right")}
            for starts, ends, slots, gold, k in zip(*(numbers(b.column(c)) for c in ("starts", "ends", "slots", "gold")), b.column("k").to_pylist(), strict=True):
                e = m.emissions(slots.reshape(len(gold), -1)) if len(gold) else np.zeros((0, len(m.tags)))
                bounds = list(zip(starts.tolist(), ends.tolist(), strict=True))
                spans = lambda tags: chain.spans_of(bounds, tags)  # noqa: B023, E731
                truth, raw = set(spans([m.tags[g] for g in gold])), spans(chain.viterbi(e, m.move, m.tags))
                # the best sequence of all is the best with its own number of spans
                exact = raw if len(raw) == k else spans(chain.counted_viterbi(e, m.move, m.tags, k))
                made = (len(gold), chain.sequence_nll(e, gold, m.move, m.tags) if len(gold) else 0.0, raw, len(truth & set(raw)), exact, len(truth & set(exact)))
                for n, v in zip(out, made, strict=True):
                    out[n].append([dict(zip(("start", "end", "label"), x, strict=True)) for x in v] if n in ("raw", "exact") else v)
            kinds = {"tokens": pa.int32(), "nll": pa.float64(), "raw": span, "raw_right": pa.int32(), "exact": span, "exact_right": pa.int32()}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k", "unaligned")), *(pa.array(v, kinds[n]) for n, v in out.items())], ["doc_id", "k", "unaligned", *out])

    kind, spans = rows.schema["doc_id"].dataType.simpleString(), "array<struct<start:int,end:int,label:string>>"
    return rows.mapInArrow(run, f"doc_id {kind}, k int, unaligned int, tokens int, nll double, raw {spans}, raw_right int, exact {spans}, exact_right int")
