"""Span candidates: tokens, patterns, a phrase dictionary with smoothed precision, contexts.

Offsets count code points and come from Python's regex engine, in Arrow batches over whole documents; no
operator here shuffles text. The dictionary is sent to the tasks, so its bytes are checked against a bound; beyond
it, phrases meet the text by an equi-join on word runs.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from quillspan.operators.keyfilter import FILTER_BITS
from quillspan.sources.scratch import materialize

TOKEN = r"\w+|[^\w\s]"
#: Candidate patterns as (label, pattern, score).
PATTERNS = (
    ("EMAIL", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+", 0.85),
    ("PHONE", r"(?<!\w)(?:\+1[ -]?)?\(\d{3}\)[ -]?\d{3}-\d{4}(?!\d)", 0.8),
    ("DATE", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}\b|\b\d{4}-\d{2}-\d{2}\b", 0.8),
)
#: What introduces a username, its score, and words that are none.
USERNAME_CONTEXT = r"(?i)\b(?:username|user\s+name|user\s+id|login\s+id)\s*(?:is\b|was\b|:|=)?\s*['\"`]?([A-Za-z0-9][A-Za-z0-9_.@-]{2,63})"
USERNAME_SCORE = 0.5
NO_USERNAME = frozenset({"is", "was", "for", "and", "the", "your", "will", "should", "has", "can"})
#: Documents, and characters of their texts, whose tokens are held at once (or one document).
DOCUMENTS, CHARACTERS = 256, 1 << 20
#: Characters of the phrases sent to the tasks at most (a matcher takes some 100 bytes for each).
MAX_CHARS = 2_000_000
_MATCHERS: dict = {}


def _scan(docs: DataFrame, doc: str, text: str, schema: str, found) -> DataFrame:
    """Rows (doc_id, ...) that ``found(text)`` yields for each document."""
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                rows = [list(found(x or "")) for x in piece.column("text").to_pylist()]
                take = pa.array([i for i, r in enumerate(rows) for _ in r], pa.int64())
                flat = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(names)
                cols = [pa.array(c, pa.int32() if s.endswith(" int") else pa.float64() if s.endswith(" double") else pa.string()) for c, s in zip(flat, schema.split(", "), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(take), *cols], ["doc_id", *names])

    return slim.mapInArrow(run, f"doc_id {kind}, {schema}")


def tokenize(docs: DataFrame, doc: str = "doc_id", text: str = "text", pattern: str = TOKEN) -> DataFrame:
    """(doc_id, i, start, end, token) for every match of the pattern."""
    rule = re.compile(pattern)
    return _scan(docs, doc, text, "i int, start int, end int, token string", lambda t: ((i, m.start(), m.end(), m.group()) for i, m in enumerate(rule.finditer(t))))


def _stretches(piece: list[str]) -> Iterator[slice]:
    """Texts in stretches of bounded size."""
    low, size = 0, 0
    for i, t in enumerate(piece):
        if i > low and (i - low >= DOCUMENTS or size + len(t) > CHARACTERS):
            yield slice(low, i)
            low, size = i, 0
        size += len(t)
    if low < len(piece):
        yield slice(low, len(piece))


def _broken(text: str, bounds: np.ndarray) -> np.ndarray:
    """Whether a newline lies before each token, after the one before it, and whether one lies after the last."""
    lines = [m.start() for m in re.finditer("\n", text)]
    low, high = np.append(0, bounds[:, 1]), np.append(bounds[:, 0], len(text))
    return np.searchsorted(lines, low) < np.searchsorted(lines, high)


def tokens_in_context(docs: DataFrame, reach: int = 2, doc: str = "doc_id", text: str = "text", pattern: str = TOKEN) -> DataFrame:
    """As ``tokenize``, with what the neighbours say: ``t-2`` to ``t+2`` (tokens up to ``reach`` away), ``before`` and ``after``
    (end of the token before, start of the one after; null without one), and whether newlines lie in the gaps to them or to
    the text's borders. A document is read as a whole where it lies, so neither tokens nor texts are shuffled; its
    tokens follow each other in order."""
    rule, steps = re.compile(pattern), [d for d in range(-reach, reach + 1) if d]
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["i", "start", "end", "token", *[f"t{d:+d}" for d in steps], "before", "after", "left_newline", "right_newline"]
    schema = ", ".join(f"`{n}` {'string' if n[0] == 't' else 'boolean' if n.endswith('newline') else 'int'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            for part in _stretches(texts):
                own = texts[part]
                spans = [[m.span() for m in rule.finditer(t)] for t in own]
                n = np.array([len(x) for x in spans], np.int64)
                bounds = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
                tokens = pa.array([t[x:y] for t, s in zip(own, spans, strict=True) for x, y in s], pa.string())
                first = np.repeat(np.cumsum(n) - n, n)
                size, at = np.repeat(n, n), np.arange(len(bounds))
                i = at - first
                near = lambda values, d: values.take(pa.array(at + d, mask=(i + d < 0) | (i + d >= size)))  # noqa: B023, E731
                start, end = pa.array(bounds[:, 0]), pa.array(bounds[:, 1])
                gaps = [_broken(t, np.array(s, np.int64).reshape(-1, 2)) for t, s in zip(own, spans, strict=True)]
                left, right = (np.concatenate([g[x] for g in gaps]) for x in (slice(None, -1), slice(1, None)))
                whose = b.column("doc_id").take(pa.array(np.repeat(np.arange(part.start, part.stop), n)))
                yield pa.RecordBatch.from_arrays([whose, pa.array(i, pa.int32()), start, end, tokens, *[near(tokens, d) for d in steps], near(end, -1), near(start, 1), pa.array(left), pa.array(right)], ["doc_id", *names])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {schema}")


def pattern_hits(docs: DataFrame, doc: str = "doc_id", text: str = "text", patterns=PATTERNS) -> DataFrame:
    """(doc_id, start, end, label, score) of the patterns' matches."""
    rules = [(label, re.compile(p), s) for label, p, s in patterns]
    return _scan(docs, doc, text, "start int, end int, label string, score double", lambda t: ((m.start(), m.end(), label, s) for label, r, s in rules for m in r.finditer(t)))


def username_hits(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, label, score) of words introduced as usernames, without closing punctuation."""
    rule = re.compile(USERNAME_CONTEXT)

    def found(t: str):
        for m in rule.finditer(t):
            value = m.group(1).rstrip(".,;:")
            if value and value.lower() not in NO_USERNAME:
                yield m.start(1), m.start(1) + len(value), "USERNAME", USERNAME_SCORE

    return _scan(docs, doc, text, "start int, end int, label string, score double", found)


class Matcher:
    """An automaton of some phrases, and which characters are letters or digits."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(phrases):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.phrases = pa.array(phrases, pa.string())
        self.in_run = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and places of the phrases that occur, nested ones too, but for those that start or end inside a run
        of letters and digits."""
        hits = np.array(list(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, which = hits[:, 0] + 1, hits[:, 1]
        start = end - self.lengths[which]
        run = np.zeros(len(text) + 2, bool)
        run[1:-1] = self.in_run[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        whole = ~(run[start] & run[start + 1]) & ~(run[end] & run[end + 1])
        return start[whole], end[whole], which[whole]


def _matcher(phrases: list[str], key: str) -> Matcher:
    """The matcher of some phrases; the last one is kept by each worker."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(phrases)
    return _MATCHERS[key]


def dictionary_hits(docs: DataFrame, phrases: DataFrame, doc: str = "doc_id", text: str = "text", phrase: str = "phrase") -> DataFrame:
    """(doc_id, start, end, phrase): every occurrence of every phrase. The phrases are sent to the tasks."""
    own = phrases.select(F.col(phrase).alias("p")).where(F.length("p") > 0).distinct()
    if (own.agg(F.sum(F.length("p"))).first()[0] or 0) > MAX_CHARS:
        return dictionary_join(docs, phrases, doc, text, phrase)
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(sorted(own.toArrow().column(0).to_pylist()))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value:
            return
        matcher = _matcher(sent.value, key)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                found = [matcher.find(x.as_py() or "") for x in piece.column("text")]
                start, end, which = (np.concatenate(c) for c in zip(*found, strict=True))
                own = piece.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                yield pa.RecordBatch.from_arrays([own, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), matcher.phrases.take(pa.array(which))], ["doc_id", "start", "end", "phrase"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, start int, end int, phrase string")


_PIECE = re.compile(r"[^\W_]+|[\W_]")


def _bitmap(keys: DataFrame, name: str) -> bytes:
    """A bit for each CRC-32 of the keys, modulo ``FILTER_BITS``: of fixed size, whatever their number."""
    at = F.pmod(F.crc32(F.col(name).cast("binary")), F.lit(FILTER_BITS))
    one = keys.select(F.floor(at / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    met = one.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, "<i8")
    out[met.column("word").to_numpy()] = met.column("bits").to_numpy()
    return out.tobytes()


def dictionary_join(docs: DataFrame, phrases: DataFrame, doc: str = "doc_id", text: str = "text", phrase: str = "phrase", runs: int = 8) -> DataFrame:
    """As ``dictionary_hits`` for a dictionary of any size: substrings that run from one edge of letters and
    digits to another meet the phrases by an equi-join. Phrases of more than ``runs`` pieces are met by their first
    pieces; such a substring carries the text that follows, as far as the longest phrase could reach, to compare.

    Two bitmaps of fixed size, of the phrases' heads and of their first pieces, are sent to the tasks: a substring becomes
    a row, and is shuffled, only if it may be a head. So rows follow the occurrences, not the text's pieces."""
    own = phrases.select(F.col(phrase).alias("p")).where(F.length("p") > 0).distinct()

    def cut(p: str) -> Iterator[tuple]:
        pieces = _PIECE.findall(p)
        yield "".join(pieces[:runs]), pieces[0], len(pieces)

    heads = materialize(_scan(own, "p", "p", "head string, first string, pieces int", cut).withColumnRenamed("doc_id", "p"), "dictionary-heads")
    longest, most = heads.agg(F.coalesce(F.max(F.length("p") - F.length("head")), F.lit(0)), F.coalesce(F.max("pieces"), F.lit(0))).first()
    reach = min(runs, most)
    sent = docs.sparkSession.sparkContext.broadcast((_bitmap(heads, "head"), _bitmap(heads, "first")))
    mask = FILTER_BITS - 1

    def found(t: str):
        whole, first = sent.value
        at = [m.span() for m in _PIECE.finditer(t)]
        for i, (a, b) in enumerate(at):
            h = zlib.crc32(t[a:b].encode()) & mask
            if not first[h >> 3] >> (h & 7) & 1:
                continue
            for j in range(i, min(i + reach, len(at))):
                b = at[j][1]
                raw = t[a:b]
                h = zlib.crc32(raw.encode()) & mask
                if whole[h >> 3] >> (h & 7) & 1:
                    yield a, raw, t[b : b + longest + 1] if j == i + runs - 1 else ""

    grams = _scan(docs, doc, text, "start int, gram string, rest string", found)
    met = grams.join(heads.select("p", "head"), F.col("gram") == F.col("head")).withColumn("more", F.expr("substring(p, length(head) + 1)"))
    edge = F.concat(F.substring("p", -1, 1), F.substring("rest", F.length("more") + 1, F.lit(1))).rlike(r"^[\p{L}\p{N}]{2}$")
    hits = met.where((F.length("more") == 0) | (F.startswith("rest", "more") & ~edge))
    return hits.select("doc_id", "start", (F.col("start") + F.length("p")).alias("end"), F.col("p").alias("phrase"))


def fit_dictionary(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(phrase, label, score, positive_occurrences, occurrences) of every annotated text.

    The label is the most frequent among occurrences that are annotated exactly (ties to the smaller), or
    among all annotations if none is; the score is (positives + 1) / (occurrences + 2).
    ``docs``: doc_id, text; ``gold``: doc_id, start, end, label, value.
    """
    gold = materialize(gold.select("doc_id", "start", "end", "label", "value"), "dictionary-gold")
    hits = dictionary_hits(docs, gold.select(F.col("value").alias("phrase")))
    marks = gold.groupBy("doc_id", "start", "end").agg(F.collect_list("label").alias("labels"))
    # texts are scanned once: what is left is one row for each phrase and set of labels
    met = materialize(hits.join(marks, ["doc_id", "start", "end"], "left").groupBy("phrase", "labels").agg(F.count("*").alias("n")), "dictionary-met")
    seen = met.groupBy("phrase").agg(F.sum("n").alias("occurrences"))
    good = met.select("phrase", F.explode("labels").alias("label"), "n").groupBy("phrase", "label").agg(F.sum("n").alias("n"))
    best = lambda d: d.groupBy("phrase").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("label").alias("l"))).alias("b"))
    hit = best(good).select("phrase", F.col("b.l").alias("hit_label"), (-F.col("b.m")).alias("positives"))
    every = best(gold.groupBy(F.col("value").alias("phrase"), "label").agg(F.count("*").alias("n"))).select("phrase", F.col("b.l").alias("all_label"))
    out = every.join(seen, "phrase", "left").join(hit, "phrase", "left")
    positives, occurrences = F.coalesce("positives", F.lit(0)), F.coalesce("occurrences", F.lit(0))
    return out.select("phrase", F.coalesce("hit_label", "all_label").alias("label"), ((positives + 1) / (occurrences + 2)).alias("score"), positives.cast("long").alias("positive_occurrences"), occurrences.cast("long").alias("occurrences"))


def pool(sources: list[DataFrame]) -> DataFrame:
    """(doc_id, start, end, label, score): the union, each span with the score of the first source that has it."""
    every = None
    for i, s in enumerate(sources):
        part = s.select("doc_id", "start", "end", "label", "score").withColumn("_p", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("doc_id", "start", "end", "label").agg(F.min(F.struct("_p", "score")).alias("x")).select("doc_id", "start", "end", "label", F.col("x.score").alias("score"))


def propose(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidates of the dictionary, then the patterns, then username contexts."""
    hits = dictionary_hits(docs, dictionary).join(dictionary.select("phrase", "label", "score"), "phrase")
    return pool([hits.drop("phrase"), pattern_hits(docs), username_hits(docs)])


def token_aligned(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with ``first`` and ``last`` token index; null where a border lies inside a token."""
    a = tokens.select("doc_id", F.col("start"), F.col("i").alias("first"))
    b = tokens.select("doc_id", F.col("end"), F.col("i").alias("last"))
    return spans.join(a, ["doc_id", "start"], "left").join(b, ["doc_id", "end"], "left")


def aligned(docs: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text", pattern: str = TOKEN) -> DataFrame:
    """As ``token_aligned``, with the tokens of the documents' texts: spans meet their text, once a document, and not a row for
    each token."""
    rule = re.compile(pattern)
    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in spans.columns])).alias("spans"))
    met = own.join(docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id", "left")
    slim = met.select("spans", "spans.start", "spans.end", "text")
    held = slim.schema["spans"].dataType
    schema = T.StructType([T.StructField("spans", held), T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("last", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                one = b.slice(row, 1)
                bounds = np.array([m.span() for m in rule.finditer(one.column("text")[0].as_py() or "")], np.int64).reshape(-1, 2)
                found = []
                for x, name in enumerate(("start", "end")):
                    asked = pa.compute.fill_null(one.column(name)[0].values, -1).to_numpy(zero_copy_only=False)
                    at = np.searchsorted(bounds[:, x], asked)
                    known = np.append(bounds[:, x], -2)
                    found.append(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at, pa.int32(), mask=known[at] != asked)))
                yield pa.RecordBatch.from_arrays([one.column("spans"), *found], ["spans", "first", "last"])

    zipped = slim.mapInArrow(run, schema).select(F.explode(F.arrays_zip("spans", "first", "last")).alias("x"))
    return zipped.select("x.spans.*", "x.first", "x.last")


#: Characters beside a span that ``in_context`` gives, and the least number of words among them for the rest to be left out.
BESIDE, ENOUGH_WORDS = 200, 4
#: What counts as a word there: a run with an ASCII letter or digit, which every pattern of words has a match in.
_PLAIN_WORD = re.compile(r"\S*[A-Za-z0-9]\S*")
_CONTEXT = {"value": pa.string(), "left": pa.string(), "right": pa.string(), "far_left": pa.string(), "far_right": pa.string(), "text_chars": pa.int32()}


def _beside(text: str | None, start: int | None, end: int | None) -> tuple:
    """The values of ``_CONTEXT`` for one span."""
    if text is None or start is None or end is None:
        return (None,) * 5 + (None if text is None else len(text),)
    left, right = text[max(0, start - BESIDE) : start], text[end : end + BESIDE]
    wanted = lambda more, side: more and len(_PLAIN_WORD.findall(side)) < ENOUGH_WORDS
    return text[start:end], left, right, text[:start] if wanted(start > BESIDE, left) else None, text[end:] if wanted(end + BESIDE < len(text), right) else None, len(text)


def in_context(docs: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans (doc_id, start, end, ...) with ``value``, ``left`` and ``right`` (up to ``BESIDE`` characters beside it), ``far_left`` and
    ``far_right`` (the whole side where a longer one has fewer than ``ENOUGH_WORDS`` words there, else null), ``text_chars``, and
    the documents' columns ``keep``.

    Spans meet their text once a document and leave it with what is near them, so no text goes through a row for each span. Spans
    of documents that there are not are left out."""
    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in spans.columns])).alias("spans"))
    met = own.join(docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"), *keep), "doc_id").select("spans", "text", *keep)
    schema = T.StructType([*spans.schema.fields, *(T.StructField(c, T.IntegerType() if t == pa.int32() else T.StringType()) for c, t in _CONTEXT.items()), *(met.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for part in _stretches([x or "" for x in texts]):
                piece = b.slice(part.start, part.stop - part.start)
                held = piece.column("spans").flatten()
                start, end = (held.field(c).to_pylist() for c in ("start", "end"))
                whose = np.repeat(np.arange(len(piece)), pa.compute.list_value_length(piece.column("spans")).to_numpy())
                found = [_beside(texts[part.start + w], x, y) for w, x, y in zip(whose.tolist(), start, end, strict=True)]
                shown = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * len(_CONTEXT), _CONTEXT.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(held.field(i) for i in range(held.type.num_fields)), *shown, *(piece.column(c).take(pa.array(whose)) for c in keep)], schema.names)

    return met.mapInArrow(run, schema)


def span_universe(lengths: DataFrame, width: int = 16, doc: str = "doc_id", n: str = "n") -> DataFrame:
    """(doc_id, a, b): all token intervals of at most ``width`` tokens."""
    ends = lengths.where(F.col(n) >= 1).select(doc, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("b"))
    return ends.select(doc, F.explode(F.sequence(F.greatest(F.lit(0), F.col("b") - width), F.col("b") - 1)).alias("a"), "b")


def substitutions(gold: DataFrame, intervals: DataFrame) -> DataFrame:
    """Gold spans with every interval that fits between their neighbours: doc_id, slot, start, end, x, y."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    g = gold.withColumns({"slot": F.row_number().over(w), "left": F.coalesce(F.lag("end").over(w), F.lit(0)), "right": F.lead("start").over(w)})
    i = intervals.select(F.col("doc_id").alias("d"), F.col("a").alias("x"), F.col("b").alias("y"))
    fits = (F.col("doc_id") == F.col("d")) & (F.col("x") >= F.col("left")) & (F.col("right").isNull() | (F.col("y") <= F.col("right")))
    return g.join(i, fits).select("doc_id", "slot", "start", "end", "x", "y")


def sampling_plan(universe: DataFrame, gold: DataFrame, old: DataFrame) -> DataFrame:
    """(doc_id, a, b, kind, flags) of token intervals for training: positive; forced (flag 2: a border of a
    positive moved by one or two tokens, flag 4: an old prediction); remaining. ``gold`` and ``old`` are token
    intervals (doc_id, a, b)."""
    pos = gold.select("doc_id", "a", "b").withColumn("pos", F.lit(True))
    moves = F.explode(F.array(*[F.struct((F.col("a") + dx).alias("a"), (F.col("b") + dy).alias("b")) for d in (-2, -1, 1, 2) for dx, dy in ((d, 0), (0, d))]))
    near = gold.select("doc_id", moves.alias("m")).select("doc_id", "m.*").withColumn("f", F.lit(2))
    flags = near.unionByName(old.select("doc_id", "a", "b").withColumn("f", F.lit(4))).groupBy("doc_id", "a", "b").agg(F.bit_or("f").alias("flags"))
    out = universe.join(pos, ["doc_id", "a", "b"], "left").join(flags, ["doc_id", "a", "b"], "left")
    kind = F.when(F.col("pos"), "positive").when(F.col("flags").isNotNull(), "forced").otherwise("remaining")
    return out.select("doc_id", "a", "b", kind.alias("kind"), F.when(kind == "forced", F.col("flags")).otherwise(0).alias("flags"))


#: Token borders whose intervals are in memory at once.
PLAN_ENDS = 1 << 16


def interval_plan(lengths: DataFrame, gold: DataFrame, old: DataFrame, width: int = 16, doc: str = "doc_id", n: str = "n") -> DataFrame:
    """As ``sampling_plan`` over ``span_universe(lengths, width)``. The marked intervals are gathered by document and looked up
    where its intervals are made, so no row of the universe is shuffled. A document's id stands in ``lengths`` once."""
    kind = lengths.schema[doc].dataType.simpleString()
    marks = gold.select("doc_id", "a", "b", F.lit(1).alias("f")).unionByName(old.select("doc_id", "a", "b", F.lit(4).alias("f")))
    held = marks.groupBy("doc_id").agg(*[F.collect_list(F.col(c).cast("long")).alias(c) for c in ("a", "b", "f")])
    own = lengths.where(F.col(n) >= 1).select(F.col(doc).alias("doc_id"), F.col(n).cast("long").alias("n")).join(held, "doc_id", "left")

    def joined(ids: pa.Array, pieces: list[tuple]) -> pa.RecordBatch:
        whose, *rest = (np.concatenate(x) for x in zip(*pieces, strict=True))
        a, b, name, flag = (pa.array(x) for x in rest)
        named = pa.DictionaryArray.from_arrays(name, ["positive", "forced", "remaining"]).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(whose)), a, b, named, flag], ["doc_id", "a", "b", "kind", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, rows = [], 0
            for i in range(batch.num_rows):
                size = batch.column("n")[i].as_py()
                a, b, f = (np.array(batch.column(c)[i].as_py() or [], np.int64) for c in ("a", "b", "f"))
                hits, forced = np.unique(_code(a[f == 1], b[f == 1])), [(a[f == 4], b[f == 4], 4)]
                for d in (-2, -1, 1, 2):
                    forced += [(a[f == 1] + d, b[f == 1], 2), (a[f == 1], b[f == 1] + d, 2)]
                at, which = np.unique(_code(*(np.concatenate([x[j] for x in forced]) for j in (0, 1))), return_inverse=True)
                flags = np.zeros(len(at) + 1, np.int32)
                np.bitwise_or.at(flags, which, np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in forced]))
                for low in range(1, size + 1, PLAN_ENDS):
                    ends = np.arange(low, min(size + 1, low + PLAN_ENDS))
                    starts = ends[:, None] - np.arange(min(width, size), 0, -1)
                    keep = starts >= 0
                    e, s = np.broadcast_to(ends[:, None], starts.shape)[keep], starts[keep]
                    code = _code(s, e)
                    positive = np.isin(code, hits)
                    place = np.searchsorted(at, code)
                    flag = np.where(np.append(at, -1)[place] == code, flags[place], 0)
                    name = np.where(positive, 0, np.where(flag > 0, 1, 2)).astype(np.int8)
                    pieces.append((np.full(len(s), i), s.astype(np.int32), e.astype(np.int32), name, np.where(name == 1, flag, 0).astype(np.int32)))
                    rows += len(s)
                    if rows >= PLAN_ENDS:
                        yield joined(batch.column("doc_id"), pieces)
                        pieces, rows = [], 0
            if pieces:
                yield joined(batch.column("doc_id"), pieces)

    return own.mapInArrow(run, f"doc_id {kind}, a int, b int, kind string, flags int")


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each interval that may be: those with a border below 0 have a negative one."""
    return np.where(a < 0, -1, (a << 32) + b)
