"""Quality rules: per-document counts and cross-document line frequency, in built-in expressions only.

Base rules count characters, symbols, repeated lines and repeated three-word windows inside each
document. The cross-document rule hashes every normalised line, counts in how many documents of a host
(here: ``source``) it stands, and removes lines above a limit; a document that keeps too few of its
words is rejected as depleted.

The limit is a share of a host's distinct texts, above a floor of a handful, and lines are counted by distinct
texts too, so it works alike at every size and copies do not raise it.

Defined results: a null or empty text has no words and fails the base rules; null sources form one host;
a null ``doc_id`` is an id like any other; repeated rows are judged alike (each row gives a row); exact
copies of a text count as one document of a host; extra columns are ignored (or kept, by ``filter``).
Of the documents that hold a line above its limit, the one with the smallest id keeps it, so that a
passage shared by many documents is not lost from the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.llm.common import SPACES, WORD, bind, words
from quillspan.operators.keyfilter import key_filter, split
from quillspan.sources.scratch import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is above its host's limit in more than this many distinct texts and more than this share of them.
LINE_DOCS, LINE_SHARE = 5, 0.02
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.5
#: Over-limit lines are broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_LINES = 200_000
_POS_BITS = 24
_KEY = ("_id", "_host", "_hash")


def _covered(starts: Column) -> Column:
    """Words covered by three-word windows at the given sorted starts."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def _near(sorted_keys: Column, x: Column, i: Column, same) -> Column:
    """Whether the element beside x, on either side, is the ``same``."""
    return F.coalesce(same(x, F.get(sorted_keys, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(sorted_keys, i + 1)), F.lit(False))


def repeated_window_words(w: Column) -> Column:
    """Words in three-word windows that stand twice or more in the word array ``w``, the first included.

    Windows are packed as hash prefix and position into longs and sorted, so equal windows meet without a
    quadratic search. Should two different windows share a prefix (or a text pass 2^24 words), the full
    hashes are sorted instead.
    """
    low = (1 << _POS_BITS) - 1
    hashes = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def by_full_hash(h: Column) -> Column:
        return bind(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p")))),
            lambda s: _covered(F.array_sort(F.transform(F.filter(s, lambda x, i: _near(s, x, i, lambda a, b: a["h"] == b["h"])), lambda x: x["p"]))),
        )

    def by_prefix(h: Column) -> Column:
        prefix = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), _POS_BITS) == 0
        pos = lambda x: x.bitwiseAND(F.lit(low).cast("long"))
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low).cast("long")).bitwiseOR(i.cast("long"))))
        clash = lambda p: F.exists(
            F.transform(p, lambda x, i: F.coalesce(prefix(x, F.get(p, i + 1)) & (F.get(h, pos(x).cast("int")) != F.get(h, pos(F.get(p, i + 1)).cast("int"))), F.lit(False))),
            lambda x: x,
        )
        found = bind(packed, lambda s: F.filter(s, lambda x, i: _near(s, x, i, prefix)))
        return bind(found, lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).when(clash(p), by_full_hash(h)).otherwise(_covered(F.sort_array(F.transform(p, pos)))))

    return bind(hashes, lambda h: F.when(F.size(h) > low, by_full_hash(h)).otherwise(by_prefix(h)))


def base_stats(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for a text."""
    text = F.coalesce(text, F.lit(""))
    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return F.struct(
        bind(
            words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                repeated_window_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bind(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def _keyed(docs: DataFrame, text: str, host: str, doc_id: str) -> DataFrame:
    return docs.withColumns({"_text": F.coalesce(F.col(text).cast("string"), F.lit("")), "_host": F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")), "_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long"))}).withColumn("_hash", F.xxhash64("_text"))


def normalized(line: Column) -> Column:
    """A line as compared across documents: lower case, single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def _lines() -> Column:
    """Hash and words of every line of ``_text`` with a word."""
    with_word = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    return F.transform(with_word, lambda x: bind(normalized(x), lambda n: F.struct(F.xxhash64(n).alias("line"), (F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).alias("n"))))


def _frequent(rows: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """(_host, line, first_id): lines above their host's limit, and the smallest document id, which keeps each.
    ``rows``: _id, _host, _hash, lines."""
    sizes = rows.select("_host", "_hash").distinct().groupBy("_host").agg(F.count("*").alias("n_host")).select(F.col("_host").alias("h"), "n_host")
    each = rows.select("_id", "_host", "_hash", F.explode("lines").alias("x")).select("_id", "_host", "_hash", "x.line")
    counts = each.groupBy("_host", "line", "_hash").agg(F.min("_id").alias("first")).groupBy("_host", "line").agg(F.count("*").alias("n_docs"), F.min("first").alias("first_id"))
    over = counts.where(F.col("n_docs") > line_docs).join(sizes, F.col("h") == F.col("_host"))
    return materialize(over.where(F.col("n_docs") > line_share * F.col("n_host")).select("_host", "line", "first_id"), "lines")


def _hits(rows: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, n): the over-limit lines that documents lose, one row for each place."""
    if lines.count() <= BROADCAST_LINES:
        lines = F.broadcast(lines)
    each = rows.select(*dict.fromkeys([*keys, "_id", "_host"]), F.explode("lines").alias("x")).select("*", "x.line", "x.n")
    return each.join(lines, ["_host", "line"]).where("_id <> first_id").select(*keys, "line", "n")


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """Counts and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_line_words_removed, base_failed, kept.

    Texts are read once; their counts and line hashes are written, each row under a number of its own."""
    keyed = _keyed(docs, text, host, doc_id)
    rows = keyed.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), "_id", "_host", "_hash", base_stats(F.col("_text")).alias("s"), _lines().alias("lines"))
    rows = materialize(rows, "quality")
    lost = _hits(rows, _frequent(rows, line_docs, line_share), "_row").groupBy("_row").agg(F.sum("n").cast("long").alias("lost"))
    stats = rows.select("_row", "doc_id", "s.w.*", "s.n_symbols", "s.n_dup_lines")
    joined = stats.join(lost, "_row", "left").withColumn("n_line_words_removed", F.coalesce("lost", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words_removed") >= MIN_LEFT * F.col("n_words")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words_removed", failed.alias("base_failed"), (~failed & left).alias("kept"))


def filter(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """The documents that ``judge`` keeps, all their columns as they were but the text: over-limit lines are cut out.

    One scan takes the line hashes, another decides and edits: the lines to cut reach a document by its id, host
    and text, so no key gathers many documents.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"x_{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"x_{docs.columns.index(c)}" for c in (text, host, doc_id)}
    keyed = _keyed(own, at[text], at[host], at[doc_id])
    rows = materialize(keyed.select("_id", "_host", "_hash", _lines().alias("lines")), "quality")
    cut = _hits(rows, _frequent(rows, line_docs, line_share), *_KEY).groupBy(*_KEY).agg(F.collect_set("line").alias("_cut"))
    cut = materialize(cut, "lines-cut")
    # a generator, not a filter: the counts of a text are then computed once
    fine = bind(base_stats(F.col("_text")), lambda s: F.struct(s["w"]["n_words"].alias("n"), s["w"]["n_repeat_words"].alias("r")))
    judged = keyed.withColumn("_s", F.explode(F.filter(F.array(fine), lambda s: (s["n"] >= MIN_WORDS) & (100 * s["r"] <= MAX_REPEAT_PERCENT * s["n"]))))
    # only texts that may lose a line are shuffled
    some, none = split(judged, key_filter(cut, *_KEY), *_KEY)
    met = some.join(cut, list(_KEY), "left").unionByName(none.withColumn("_cut", F.lit(None).cast("array<bigint>")))
    keep = F.filter(F.split("_text", "\n", -1), lambda x: ~F.array_contains(F.col("_cut"), F.xxhash64(normalized(x))))
    edited = F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.array_join(keep, "\n"))
    left = lambda t: F.col("_cut").isNull() | (F.size(words(t)) >= MIN_LEFT * F.col("_s.n"))
    out = met.withColumn("_new", F.explode(F.filter(F.array(edited), left)))
    new = {text: F.col("_new")} | ({"n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"x_{i}")).alias(c) for i, c in enumerate(docs.columns)])
