"""Queries that fit and apply models, and the end-to-end slice."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspan.functions.text import group_hash
from quillspan.operators import boosting, calibration, candidates, chain, decode, evaluation, newton, reassembly, scoring, sequence, spanhead
from quillspan.schemas import LABELS, TAGS
from quillspan.sources import adapters
from quillspan.sources.adapters import read, segments
from quillspan.sources.scratch import materialize

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


ORACLES["token_emissions"] = r"""
WITH t AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]') AS ts FROM documents)),
f AS (SELECT doc_id, i, 'len=' || least(length(t), 9) AS feature FROM t UNION ALL SELECT doc_id, i, 'cap=' || regexp_matches(t, '^\p{Lu}') FROM t),
w(feature, label, weight) AS (VALUES ('cap=true', 'B-NAME', 1.5::DOUBLE), ('cap=false', 'O', 0.5), ('len=1', 'O', 1.0))
SELECT doc_id, i::INT AS i, label, sum(weight) AS emission FROM f JOIN w USING (feature) GROUP BY 1, 2, 3"""
#: The names outscore all else and do not overlap, so exactly as many spans as there are names are the names.
ORACLES["end_to_end_slice"] = r"""
SELECT doc_id, true AS contiguous, true AS same_length, true AS same_text, n AS n_gold, n AS n_predicted, n AS slot_correct, n AS entity_correct FROM (
  SELECT doc_id, len(list_filter(string_split_regex(text, '\s')[1:-2], lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))) AS n FROM documents)"""


def candidate_table(spark, d) -> DataFrame:
    """Candidates with features of their text and neighbours, a label y, and a fold by document."""
    g = adapters.gold(spark, d)
    c = adapters.candidates(g).join(g.select(*evaluation.SPAN, F.lit(1).alias("y")), evaluation.SPAN, "left")
    c = candidates.in_context(read(spark, d, "documents"), c.withColumn("y", F.coalesce("y", F.lit(0))), keep=("lang",))
    value, right = F.col("value"), F.left("right", F.lit(1))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score")))
    return c.select(*evaluation.SPAN, "y", "lang", value.alias("phrase"), F.length(value).cast("double").alias("chars"), (F.col("start") / F.greatest(F.lit(1), F.col("text_chars"))).alias("position"), F.ln(p / (1 - p)).alias("prior_logit"), right.alias("right_char"), right.rlike(r"(?U)[\w]").cast("double").alias("right_word"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("fold"))


@query
def candidate_logistic(spark, d):
    t = materialize(candidate_table(spark, d), "candidates")
    model = scoring.hashed_logistic(t.where("fold > 0"), ["label", "lang", "right_char", "chars", "position", "prior_logit"])
    return scoring.probability(model, t).select(*evaluation.SPAN, "y", F.round("score", 6).alias("score"))


@query
def candidate_trees(spark, d):
    t = materialize(candidate_table(spark, d), "candidates")
    model = scoring.boosted_trees(t.where("fold > 0"), ["chars", "position", "prior_logit", "right_word"], ["label", "lang"])
    return scoring.probability(model, t).select(*evaluation.SPAN, "y", F.round("score", 6).alias("score"))


@query
def style_classifier(spark, d):
    t = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("y"))
    t = t.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = scoring.style_classifier(t.where("not held_out"))
    return scoring.probability(model, t).select("doc_id", "y", "held_out", F.round("score", 6).alias("score"))


@query
def linear_probe_oof(spark, d):
    t = materialize(candidate_table(spark, d), "candidates")
    fit = lambda rows: scoring.linear_probe(rows, ["chars", "position", "prior_logit", "right_word"])
    return scoring.out_of_fold(t, "fold", 3, fit).select(*evaluation.SPAN, "y", "fold", F.round("score", 6).alias("score"))


@query
def token_emissions(spark, d):
    tokens = candidates.tokenize(read(spark, d, "documents"))
    f = tokens.select("doc_id", "i", F.explode(F.array(F.concat(F.lit("len="), F.least(F.length("token"), F.lit(9)).cast("string")), F.concat(F.lit("cap="), F.col("token").rlike(r"^\p{Lu}").cast("string")))).alias("feature"), F.lit(1.0).alias("value"))
    w = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(x).alias("label"), F.lit(v).alias("weight")) for f, x, v in (("cap=true", "B-NAME", 1.5), ("cap=false", "O", 0.5), ("len=1", "O", 1.0))])).alias("x")).select("x.*")
    return scoring.linear_emissions(f, w, ["doc_id", "i"])


#: Rounds of the registered training.
CRF_ROUNDS = 25


def tagged_documents(spark, d) -> DataFrame:
    return sequence.training_rows(read(spark, d, "documents"), adapters.phrases(spark, d), TAGS)


@query
def crf_training(spark, d):
    """The penalised loss of each round of training a linear chain on all documents, and the jobs that it took."""
    _, log = sequence.train(tagged_documents(spark, d), TAGS, rounds=CRF_ROUNDS)
    return spark.createDataFrame([(i, r.loss, r.steepness, r.evaluations) for i, r in enumerate(log)], "round int, loss double, steepness double, evaluations int")


@query
def crf_exact_k(spark, d):
    """Each document under the trained chain: its best tags, and its best tags with the known number of spans."""
    rows = tagged_documents(spark, d)
    model, _ = sequence.train(rows, TAGS, rounds=CRF_ROUNDS)
    return sequence.tagged(rows, model).select("doc_id", "tokens", "k", "unaligned", F.round("nll", 3).alias("nll"), F.size("raw").alias("raw_spans"), "raw_right", F.size("exact").alias("exact_spans"), "exact_right")


@query
def transition_fit(spark, d):
    """Moves between tags, fitted to the gold tags with emissions that only tell a token's first letter and length."""
    rows = sequence.with_spans(read(spark, d, "documents"), adapters.phrases(spark, d))
    token, cap, small, place = re.compile(candidates.TOKEN), re.compile("[A-Z][a-z]{3,}"), re.compile("[a-z]{1,5}"), {t: i for i, t in enumerate(TAGS)}
    # of a capital word with its label's tag, of others; with a small word, of others
    table = np.array([[0.5 if t == "O" else (1.5 if x == t[2:] else -2.0) if t[0] == "B" else y for t in TAGS] for x in (*LABELS, "") for y in (0.25, -2.0)])

    def run(batches):
        for batch in batches:
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                found = list(token.finditer(text.as_py() or ""))
                which = [2 * (len(t) % len(LABELS) if cap.fullmatch(t) else len(LABELS)) + (small.fullmatch(t) is None) for t in (m.group() for m in found)]
                tags, _ = chain.tags_of([m.span() for m in found], [(s["start"], s["end"], s["label"]) for s in spans.as_py() or []])
                yield pa.RecordBatch.from_arrays([pa.array([table[which].ravel()]), pa.array([[place[t] for t in tags]], pa.list_(pa.int32()))], ["emission", "gold"])

    move, _ = sequence.fit_transitions(rows.mapInArrow(run, "emission array<double>, gold array<int>"), TAGS, l2=0.01)
    ok = chain.legal(TAGS)
    return spark.createDataFrame([(a, b, round(float(move[i, j]), 3)) for i, a in enumerate(TAGS) for j, b in enumerate(TAGS) if ok[i, j]], "from_tag string, to_tag string, weight double")


#: Slots (as a power of 2) and rounds of the registered interval heads; weight of the ranking loss.
HEAD_BITS, HEAD_ROUNDS, RANKING = 14, 25, 1.0


def head_stretches(spark, d) -> DataFrame:
    rows = sequence.training_rows(read(spark, d, "documents"), adapters.phrases(spark, d), TAGS, HEAD_BITS)
    return spanhead.stretches(rows, adapters.predicted(adapters.gold(spark, d)).select("doc_id", "start", "end"))


@query
def span_head(spark, d):
    """Each stretch's K best token intervals under a head that was trained on weighted samples of the intervals."""
    rows = head_stretches(spark, d)
    x, _ = spanhead.train(rows, HEAD_BITS, HEAD_ROUNDS)
    return spanhead.records(rows, x, HEAD_BITS).select("doc_id", "part", "k", "right", "map_is_gold", F.round("gap", 3).alias("gap"))


@query
def global_ranking(spark, d):
    """Gold against its strongest rival, under the head trained by samples ("control") and trained on with the ranking loss."""
    rows = head_stretches(spark, d)
    control, _ = spanhead.train(rows, HEAD_BITS, HEAD_ROUNDS)
    challenger, _ = spanhead.train(rows, HEAD_BITS, HEAD_ROUNDS, ranking=RANKING, start=control)
    out = [calibration.gap_summary(spanhead.records(rows, x, HEAD_BITS), "gap").withColumn("arm", F.lit(arm)) for arm, x in (("control", control), ("challenger", challenger))]
    return out[0].unionByName(out[1]).select("arm", "wins", "ties", "losses", F.round("mean_gap", 3).alias("mean_gap"))


ORACLES["interval_sample"] = """
WITH turns AS (SELECT conv_id * 1000 + turn AS doc_id, greatest(1, len(string_split(coalesce(text, ''), ' '))) AS n FROM conversations),
u AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY b, a) - 1 AS place FROM (SELECT doc_id, n, unnest(generate_series(1, n)) AS b FROM turns), LATERAL (SELECT unnest(generate_series(greatest(0, b - 16), b - 1)) AS a)),
pos AS (FROM u WHERE a % 10 = 3 AND b = a + 2), old AS (FROM u WHERE a % 7 = 1 AND b = a + 3),
f AS (SELECT doc_id, a, b, bit_or(f) AS flags FROM (SELECT doc_id, a + dx AS a, b + dy AS b, 2 AS f FROM pos, (VALUES (-2, 0), (-1, 0), (1, 0), (2, 0), (0, -2), (0, -1), (0, 1), (0, 2)) m(dx, dy) UNION ALL SELECT doc_id, a, b, 4 FROM old) GROUP BY 1, 2, 3),
k AS (SELECT u.*, CASE WHEN p.doc_id IS NOT NULL THEN 1 WHEN u.b > 20 AND u.a < 23 THEN -1 ELSE coalesce(f.flags, 0) END AS kind FROM u LEFT JOIN pos p USING (doc_id, a, b) LEFT JOIN f USING (doc_id, a, b)),
h AS (SELECT *, (doc_id % 2147483647 * 48271 + place * 16807 + 2026 * 69621 + 1) % 2147483647 AS x FROM k WHERE kind = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (x * x % 2147483647 * 39373 + place) % 2147483647, place) AS r, count(*) OVER (PARTITION BY doc_id) AS rest FROM h),
s AS (SELECT doc_id, a, b, kind, 1.0::DOUBLE AS w FROM k WHERE kind > 0 UNION ALL SELECT doc_id, a, b, 8, rest / least(256, rest)::DOUBLE FROM o WHERE r <= 256)
SELECT doc_id, kind, count(*)::INT AS n, round(sum(w), 6) AS weight, sum(a * 31 + b)::BIGINT AS checksum FROM s GROUP BY 1, 2"""


@query
def interval_sample(spark, d):
    """What is drawn from the intervals of every turn, with gold, earlier predictions and a protected stretch by arithmetic."""
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.greatest(F.lit(1), F.size(F.split(F.coalesce("text", F.lit("")), " "))).alias("n"))

    def kernel(row):
        n, key = int(row["n"]), int(row["doc_id"])
        plan = spanhead.sample(n, [(a, a + 2, 0) for a in range(3, n - 1, 10)], [(20, 23)], [(a, a + 3) for a in range(1, n - 2, 7)], key)
        return [{"doc_id": key, "kind": int(x), "n": int((plan.kind == x).sum()), "weight": round(float(plan.weight[plan.kind == x].sum()), 6), "checksum": int((plan.a * 31 + plan.b)[plan.kind == x].sum())} for x in np.unique(plan.kind)]

    return decode.per_document(turns, kernel, "doc_id long, kind int, n int, weight double, checksum long")


#: Trees of the registered boosting, a bounded share of the 500 that ``boosting.fit`` makes if not told otherwise.
BOOSTED_TREES = 30


@query
def candidate_boosting(spark, d):
    """Every candidate's probability under leaf-wise trees with categorical splits, fitted on two of three folds."""
    t = materialize(candidate_table(spark, d), "candidates")
    fit = t.where("fold > 0")
    binner = boosting.Binner.of(fit, ["chars", "position", "prior_logit"], ["label", "lang", "right_char"], "doc_id")
    model = boosting.fit(fit, binner, trees=BOOSTED_TREES, rate=0.1)
    return boosting.score(t, model).select(*evaluation.SPAN, "y", "fold", F.round("score", 6).alias("score"))


ORACLES["first_seen_codes"] = "SELECT source AS value, (row_number() OVER (ORDER BY min(doc_id), source) - 1)::INT AS code FROM documents WHERE source IS NOT NULL GROUP BY source"


@query
def first_seen_codes(spark, d):
    return boosting.first_seen(read(spark, d, "documents"), "source", "doc_id")


#: The features of each variant of the probes.
VARIANTS = {"form": ["chars", "right_word"], "all": ["chars", "position", "prior_logit", "right_word"]}


@query
def newton_probe(spark, d):
    """Every candidate's score by the probe of its label, fitted on the other folds, for two variants of the features."""
    t = materialize(candidate_table(spark, d), "candidates")
    out = [newton.out_of_fold(t, "fold", 3, features, by=["label"]).withColumn("variant", F.lit(name)) for name, features in VARIANTS.items()]
    return out[0].unionByName(out[1]).select("variant", *evaluation.SPAN, "y", "fold", F.round("score", 6).alias("score"))


ORACLES["probe_moments"] = f"""
WITH {adapters.SQL}, t AS (SELECT doc_id, label, length(substr(text, start + 1, "end" - start))::DOUBLE AS chars, start / greatest(1, length(text)) AS position FROM cand JOIN documents USING (doc_id))
SELECT label, round(avg(chars), 9) AS chars_mean, round(stddev_pop(chars), 9) AS chars_scale, round(avg(position), 9) AS position_mean, round(stddev_pop(position), 9) AS position_scale FROM t GROUP BY 1"""


@query
def probe_moments(spark, d):
    """What each label's features are standardised by."""
    probes = newton.fit(candidate_table(spark, d), ["chars", "position"], by=["label"])
    rows = [(k[0], *(round(float(v), 9) for x in (0, 1) for v in (p.mean[x], p.scale[x]))) for k, p in probes.items()]
    return spark.createDataFrame(rows, "label string, chars_mean double, chars_scale double, position_mean double, position_scale double")


def slice_(spark, d: str) -> DataFrame:
    """Lines -> documents -> candidates -> exactly-K decoding -> slots -> correct slots of each document."""
    shuffled = segments(spark, d).repartition("doc_id", "segment_index")
    docs = reassembly.reassemble(shuffled).select("doc_id", F.col("full_text").alias("text"), "n_chars", "contiguous")
    rule = (("NAME", r"(?<![^\s])[A-Z][a-z]{3,}(?=\s)", 0.9), ("ADDRESS", r"(?<![^\s])[A-Z][a-z]+\.(?=\s|$)", 0.6), *candidates.PATTERNS)
    spans = candidates.pool([candidates.pattern_hits(docs, patterns=rule)])
    truth = candidates.pool([candidates.pattern_hits(docs, patterns=rule[:1])]).drop("score")
    pools = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "score"))).alias("spans"))
    pools = pools.join(truth.groupBy("doc_id").agg(F.count("*").cast("int").alias("k")), "doc_id")

    def kernel(row):
        own = [(int(s["start"]), int(s["end"]), s["label"]) for s in row["spans"]]
        got = decode.best_sum(own, [float(s["score"]) for s in row["spans"]], int(row["k"]))
        return [{"doc_id": row["doc_id"], "start": a, "end": b, "label": x} for a, b, x in got]

    chosen = decode.per_document(pools, kernel, "doc_id long, start int, end int, label string")
    counts = evaluation.document_counts(truth, chosen)
    whole = docs.join(read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("stated"), group_hash(F.col("text")).alias("stated_hash")), "doc_id")
    return whole.select("doc_id", "contiguous", (F.col("n_chars") == F.col("stated")).alias("same_length"), (group_hash(F.col("text")) == F.col("stated_hash")).alias("same_text")).join(counts, "doc_id", "left").fillna(0)


@query
def end_to_end_slice(spark, d):
    return slice_(spark, d)
