"""Scoring predicted spans against gold: slots, entities, boundaries, error taxonomy, displacement.

Spans are rows (doc_id, start, end, label). Everything is a join on the document plus an aggregate; the one
range join (overlap) stays inside a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan.operators.audit import numbered

KEY = ["doc_id"]
SPAN = ["doc_id", "start", "end", "label"]


def ratio(a: Column, b: Column) -> Column:
    """a over b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def prf(correct: Column, predicted: Column, gold: Column) -> list[Column]:
    return [ratio(correct, predicted).alias("precision"), ratio(correct, gold).alias("recall"), ratio(2 * correct, predicted + gold).alias("f1")]


def aligned(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, slot, g, p): gold and predicted spans in the same place, either side null if missing."""
    g = numbered(gold).select("doc_id", "slot", F.struct("start", "end", "label").alias("g"))
    p = numbered(predicted).select("doc_id", "slot", F.struct("start", "end", "label").alias("p"))
    return g.join(p, ["doc_id", "slot"], "full_outer")


def slot_accuracy(gold: DataFrame, predicted: DataFrame, by_label: bool = False) -> DataFrame:
    """(label,) gold, slot_correct, slot_accuracy."""
    rows = aligned(gold, predicted).where("g is not null")
    keys = [F.col("g.label").alias("label")] if by_label else []
    return rows.groupBy(*keys).agg(F.count("*").alias("gold"), F.count_if(F.col("g").eqNullSafe(F.col("p"))).alias("slot_correct")).withColumn("slot_accuracy", ratio(F.col("slot_correct"), F.col("gold")))


def entity_prf(gold: DataFrame, predicted: DataFrame, keys: list[str], by_label: bool = False) -> DataFrame:
    """Counts and precision, recall, F1 of distinct spans that agree in ``keys`` (with or without label)."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, keys, "full_outer")
    group = ["label"] if by_label else []
    n = both.groupBy(*group).agg(F.count("_g").alias("gold"), F.count("_p").alias("predicted"), F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("correct"))
    return n.select("*", *prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def document_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, n_gold, n_predicted, slot_correct, entity_correct)."""
    slots = aligned(gold, predicted).groupBy("doc_id").agg(F.count("g").alias("n_gold"), F.count("p").alias("n_predicted"), F.count_if(F.col("g") == F.col("p")).alias("slot_correct"))
    same = gold.join(predicted.select(*SPAN), SPAN).groupBy("doc_id").agg(F.count("*").alias("entity_correct"))
    return slots.join(same, "doc_id", "left").withColumn("entity_correct", F.coalesce("entity_correct", F.lit(0)).cast("long"))


def count_summary(per: DataFrame) -> DataFrame:
    """One row: documents with the right, too small and too large count, exact ones, missing and excess spans."""
    d = F.col("n_predicted") - F.col("n_gold")
    exact = (d == 0) & (F.col("slot_correct") == F.col("n_gold"))
    return per.agg(F.count("*").alias("documents"), F.count_if(d == 0).alias("count_correct"), F.count_if(d < 0).alias("under_count"), F.count_if(d > 0).alias("over_count"), F.count_if(exact).alias("exact"), F.sum(F.greatest(-d, F.lit(0))).alias("missing"), F.sum(F.greatest(d, F.lit(0))).alias("excess"))


def relations(gold: DataFrame, available: DataFrame) -> DataFrame:
    """Gold spans with ``relation`` to the available ones: exact, same_boundary_wrong_label,
    overlap_same_label, overlap_wrong_label or none; the first that holds."""
    a = available.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("label").alias("l"))
    hit = gold.join(a, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left")
    bounds = (F.col("start") == F.col("s")) & (F.col("end") == F.col("e"))
    rank = F.when(bounds & (F.col("label") == F.col("l")), 0).when(bounds, 1).when(F.col("label") == F.col("l"), 2).when(F.col("s").isNotNull(), 3).otherwise(4)
    names = F.array(*map(F.lit, ("exact", "same_boundary_wrong_label", "overlap_same_label", "overlap_wrong_label", "none")))
    return hit.groupBy(*SPAN).agg(F.element_at(names, F.min(rank) + 1).alias("relation"))


def error_taxonomy(gold: DataFrame, predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, slot, candidate_category, output_category) of every gold span."""
    c = relations(gold, candidates).withColumn("candidate_category", F.when(F.col("relation") == "exact", "exact_candidate").when(F.col("relation") == "none", "no_overlapping_candidate").otherwise(F.col("relation"))).drop("relation")
    o = relations(gold, predicted).withColumnRenamed("relation", "out")
    slots = aligned(gold, predicted).where("g is not null").select("doc_id", "slot", "g.*", F.col("g").eqNullSafe(F.col("p")).alias("in_place"))
    both = slots.join(c, SPAN).join(o, SPAN)
    output = F.when((F.col("out") == "exact") & F.col("in_place"), "correct_slot").when(F.col("out") == "exact", "exact_span_wrong_slot").when(F.col("out") == "none", "no_overlapping_prediction").otherwise(F.col("out"))
    return both.select(*SPAN, "slot", "candidate_category", output.alias("output_category"))


def label_confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(gold_label, predicted_label, n) of spans with the same bounds."""
    p = predicted.select("doc_id", "start", "end", F.col("label").alias("predicted_label"))
    return gold.join(p, ["doc_id", "start", "end"]).groupBy(F.col("label").alias("gold_label"), "predicted_label").agg(F.count("*").alias("n"))


def best_overlap(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each gold span with the predicted span of largest intersection (ties in span order), where there is one."""
    p = predicted.select(F.col("doc_id").alias("d"), F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("label").alias("l")).alias("p"))
    met = gold.join(p, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("p.e")) & (F.col("p.s") < F.col("end")))
    size = F.least("end", F.col("p.e")) - F.greatest("start", F.col("p.s"))
    best = F.min(F.struct((-size).alias("m"), F.col("p"))).alias("b")
    return met.groupBy(*SPAN).agg(best).select(*SPAN, F.col("b.p.s").alias("p_start"), F.col("b.p.e").alias("p_end"), F.col("b.p.l").alias("p_label"), (-F.col("b.m")).alias("overlap"))


def common(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, gold_rank, pred_rank, displacement) of spans in both."""
    g = numbered(gold).withColumnRenamed("slot", "gold_rank").select(*SPAN, "gold_rank")
    p = numbered(predicted).withColumnRenamed("slot", "pred_rank").select(*SPAN, "pred_rank")
    return g.join(p, SPAN).withColumn("displacement", F.col("pred_rank") - F.col("gold_rank"))


def gaps(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, left_gold_rank, pred_noncommon, gold_noncommon, imbalance, cumulative, displacement).

    Between neighbouring common spans (and before the first, after the last) stand spans of one side only;
    their differences add up to the displacement of the span on the right.
    """
    n_gold, n_pred = (df.groupBy("doc_id").agg(F.count("*").alias(n)) for df, n in ((gold, "n_gold"), (predicted, "n_pred")))
    ends = n_gold.join(n_pred, "doc_id", "full_outer").select("doc_id", (F.coalesce("n_gold", F.lit(0)) + 1).cast("int").alias("gold_rank"), (F.coalesce("n_pred", F.lit(0)) + 1).cast("int").alias("pred_rank"))
    anchors = common(gold, predicted).select("doc_id", "gold_rank", "pred_rank").unionByName(ends)
    w = Window.partitionBy("doc_id").orderBy("gold_rank")
    left_g, left_p = F.coalesce(F.lag("gold_rank").over(w), F.lit(0)), F.coalesce(F.lag("pred_rank").over(w), F.lit(0))
    rows = anchors.withColumns({"left_gold_rank": left_g, "pred_noncommon": F.col("pred_rank") - left_p - 1, "gold_noncommon": F.col("gold_rank") - left_g - 1})
    rows = rows.withColumn("imbalance", F.col("pred_noncommon") - F.col("gold_noncommon"))
    return rows.withColumns({"cumulative": F.sum("imbalance").over(w), "displacement": F.col("pred_rank") - F.col("gold_rank")}).drop("pred_rank").withColumnRenamed("gold_rank", "right_gold_rank")


def episodes(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, episode, first_gold_rank, length, simple, displacement): runs of common spans out of place.
    A run is simple if all its displacements are +1, or all are -1."""
    rows = common(gold, predicted)
    w = Window.partitionBy("doc_id").orderBy("gold_rank")
    rows = rows.withColumn("episode", F.sum(F.when(F.col("displacement") == 0, 1).otherwise(0)).over(w)).where("displacement <> 0")
    low, high = F.min("displacement"), F.max("displacement")
    simple = (low == high) & (F.abs(low) == 1)
    return rows.groupBy("doc_id", "episode").agg(F.min("gold_rank").alias("first_gold_rank"), F.count("*").alias("length"), simple.alias("simple"), F.when(simple, low).alias("displacement"))


def states(gold: DataFrame, predicted: DataFrame, name: str) -> DataFrame:
    """Gold spans with column ``name``: correct (in place), wrong (elsewhere) or absent."""
    c = common(gold, predicted).select(*SPAN, F.when(F.col("displacement") == 0, "correct").otherwise("wrong").alias(name))
    return gold.select(*SPAN).join(c, SPAN, "left").withColumn(name, F.coalesce(name, F.lit("absent")))


def transitions(gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(before, after, n): what became of each gold span from one prediction to the other; the nine cells partition gold."""
    return states(gold, first, "before").join(states(gold, second, "after"), SPAN).groupBy("before", "after").agg(F.count("*").alias("n"))


def episode_outcomes(gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(outcome, n): spans of the first prediction's simple episodes that the second repaired, kept displaced or lost."""
    rows = common(gold, first)
    w = Window.partitionBy("doc_id").orderBy("gold_rank")
    rows = rows.withColumn("episode", F.sum(F.when(F.col("displacement") == 0, 1).otherwise(0)).over(w)).where("displacement <> 0")
    simple = episodes(gold, first).where("simple").select("doc_id", "episode")
    after = rows.join(simple, ["doc_id", "episode"]).join(states(gold, second, "after"), SPAN)
    outcome = F.when(F.col("after") == "correct", "REPAIRED").when(F.col("after") == "wrong", "RETAINED_DISPLACED").otherwise("LOST")
    return after.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def paired(per_a: DataFrame, per_b: DataFrame) -> DataFrame:
    """One row: documents where b is better, worse or as good as a, slots gained and lost, gain a slot."""
    a, b = per_a.select("doc_id", "n_gold", F.col("slot_correct").alias("a")), per_b.select("doc_id", F.col("slot_correct").alias("b"))
    d = F.col("b") - F.col("a")
    return a.join(b, "doc_id").agg(F.count("*").alias("documents"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), F.count_if(d == 0).alias("tied"), F.sum(F.greatest(d, F.lit(0))).alias("gained"), F.sum(F.greatest(-d, F.lit(0))).alias("lost"), ratio(F.sum(d), F.sum("n_gold")).alias("gain"))


def paired_by_pool(per_a: DataFrame, per_b: DataFrame, gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """``paired`` for documents whose gold spans are all candidates, and for the others: (complete, documents, ...)."""
    lacking = gold.select(*SPAN).join(candidates.select(*SPAN).distinct(), SPAN, "left_anti").select("doc_id").distinct().withColumn("complete", F.lit(False))
    docs = per_a.select("doc_id").join(lacking, "doc_id", "left").withColumn("complete", F.coalesce("complete", F.lit(True)))
    both = per_a.select("doc_id", "n_gold", F.col("slot_correct").alias("a")).join(per_b.select("doc_id", F.col("slot_correct").alias("b")), "doc_id").join(docs, "doc_id")
    d = F.col("b") - F.col("a")
    return both.groupBy("complete").agg(F.count("*").alias("documents"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), F.count_if(d == 0).alias("tied"), F.sum(F.greatest(d, F.lit(0))).alias("gained"), F.sum(F.greatest(-d, F.lit(0))).alias("lost"), ratio(F.sum(d), F.sum("n_gold")).alias("gain"))


def slot_ids(rows: DataFrame, column: str = "row_id") -> DataFrame:
    """``rows`` with document, slot and ``valid`` of ids like "doc_07": a number after the last underscore, of two digits
    at least, padded with zeros to two only, from 1."""
    digits = F.regexp_extract(column, r"_(\d+)$", 1)
    slot = F.expr(f"try_cast(nullif(regexp_extract({column}, '_([0-9]+)$', 1), '') as int)")
    fine = F.col(column).rlike(r"^.+_\d{2,}$") & (slot >= 1) & ((F.length(digits) == 2) | ~digits.startswith("0"))
    return rows.withColumns({"document": F.regexp_extract(column, r"^(.*)_\d+$", 1), "slot": slot, "valid": F.coalesce(fine, F.lit(False))})


def submission(predicted: DataFrame, template: DataFrame) -> DataFrame:
    """(row_order, row_id, Predicted): predictions put on the template's slots, in its order."""
    value = F.concat_ws(":", "label", F.col("start").cast("string"), F.col("end").cast("string")).alias("Predicted")
    rows = numbered(predicted).select("doc_id", "slot", value)
    return template.join(rows, ["doc_id", "slot"], "left").select("row_order", "row_id", "Predicted").orderBy("row_order")


def submission_faults(rows: DataFrame, docs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(fault, n): unknown_document, format, label, bounds, duplicate_row, overlap, count; none if the submission is sound.

    ``rows``: row_id, Predicted; ``docs``: doc_id, n_chars, expected.
    """
    parts = F.split("Predicted", ":", -1)
    parsed = rows.select("row_id", F.regexp_extract("row_id", r"^(.*)_(\d+)$", 1).alias("doc"), F.regexp_extract("row_id", r"^(.*)_(\d+)$", 2).alias("nn"), parts.alias("p"))
    at = lambda i: F.expr(f"try_cast(get(p, {i}) as int)")
    parsed = parsed.withColumns({"fmt": (F.size("p") == 3) & at(1).isNotNull() & at(2).isNotNull(), "a": at(1), "b": at(2), "slot": F.expr("try_cast(nn as int)")})
    known = parsed.join(docs.select(F.col("doc_id").cast("string").alias("doc"), "n_chars", "expected"), "doc", "left")
    w = Window.partitionBy("doc").orderBy("slot", "row_id")
    known = known.withColumns({"copies": F.count("*").over(Window.partitionBy("row_id")), "last": F.lag("b").over(w)})
    one = lambda name, c: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    faults = F.array(
        one("unknown_document", F.col("n_chars").isNull()), one("format", ~F.coalesce("fmt", F.lit(False))), one("label", F.col("fmt") & ~F.get("p", F.lit(0)).isin(*labels)),
        one("bounds", F.col("fmt") & ~((F.col("a") >= 0) & (F.col("a") < F.col("b")) & (F.col("b") <= F.col("n_chars")))), one("duplicate_row", F.col("copies") > 1), one("overlap", F.col("a") < F.col("last")),
    )
    per_row = known.select(F.explode(F.array_compact(faults)).alias("fault"))
    counts = docs.select(F.col("doc_id").cast("string").alias("doc"), "expected").join(parsed.groupBy("doc").agg(F.count("*").alias("n")), "doc", "left").where(F.coalesce("n", F.lit(0)) != F.col("expected")).select(F.lit("count").alias("fault"))
    return per_row.unionByName(counts).groupBy("fault").agg(F.count("*").alias("n"))
