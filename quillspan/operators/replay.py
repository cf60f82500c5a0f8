"""Replays of stored predictions: canonical hashes, the replay gate, scaling of energies, stages with evidence."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspan.operators.decode import Lattice, per_document, slot_mbr
from quillspan.operators.prefix import running_total
from quillspan.schemas import LABELS
from quillspan.sources import artifacts

SPANS = ("start", "end", "label")


def canonical_hash(predictions: DataFrame, doc: str = "doc_id") -> str:
    """SHA-256 of all predictions as JSON: documents in order of id, each with its (start, end, label) in the order given.

    ``predictions``: doc, predicted (array of start, end, label). Documents that repeat, spans that are out of order,
    repeated, overlapping or invalid are errors. Rows are sorted, turned into JSON and packed on the cluster, and streamed through
    the hash, one batch after the other; ``tree_hash`` is for tables that no one process should read.
    """
    order = _sound(predictions, doc)
    out = hashlib.sha256(b"[")
    for i, row in enumerate(packed_rows(predictions.select(doc, order.alias("p")).orderBy(doc), doc, "p").toLocalIterator()):
        out.update((b"," if i else b"") + zlib.decompress(row["packed"]))
    out.update(b"]")
    return out.hexdigest()


def packed_rows(ordered: DataFrame, doc: str, spans: str) -> DataFrame:
    """(packed): the rows' JSON with commas between them, compressed, a batch in each, in the order of ``ordered``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            each = zip(b.column(doc).to_pylist(), b.column(spans).to_pylist(), strict=True)
            one = (json.dumps([d, [[s[c] for c in SPANS] for s in p]], ensure_ascii=False, separators=(",", ":")) for d, p in each)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(",".join(one).encode(), 9)], pa.binary())], ["packed"])

    return ordered.select(doc, spans).mapInArrow(run, "packed binary")


def _sound(predictions: DataFrame, doc: str) -> Column:
    """The predicted spans as (start, end, label); an error if a document or a span is not as ``canonical_hash`` demands."""
    p = F.col("predicted")
    order = F.transform(p, lambda s: F.struct(*[s[c] for c in SPANS]))
    bad = F.exists(p, lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | ~s["label"].isin(*LABELS))
    apart = F.forall(F.transform(p, lambda s, i: (i == 0) | (F.coalesce(F.get(p, i - 1)["end"], F.lit(0)) <= s["start"])), lambda x: x)
    faults = predictions.select(F.count_if(bad | (order != F.array_sort(order)) | ~apart).alias("n")).first()["n"]
    if faults or not predictions.groupBy(doc).count().where("count > 1").isEmpty():
        raise ValueError("predictions repeat a document, or hold spans that are invalid, out of order or overlap")
    return order


#: Hashes that are joined into one, and how often: the tree's depth is fixed, so its root says all about its leaves.
FAN, DEPTH = 256, 5


def tree_hash(predictions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(sha256, documents): one hash of all predictions, from hashes of documents in order of id, ``FAN`` of them joined and hashed at
    each of ``DEPTH`` levels. Ranks are running totals over ranges; no task holds more than ``FAN`` hashes of a node, and the
    driver none. Faults are errors, as in ``canonical_hash``."""
    order = _sound(predictions, doc)
    leaf = F.sha2(F.to_json(F.struct(F.col(doc), order.alias("predicted"))).cast("binary"), 256)
    ranked = running_total(predictions.select(doc, leaf.alias("h"), F.lit(1).cast("long").alias("one")), [doc], {"at": "one"})
    rows = ranked.select("at", "h", "one")
    for _ in range(DEPTH):
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        rows = rows.groupBy(F.floor(F.col("at") / FAN).alias("at")).agg(F.sha2(joined.cast("binary"), 256).alias("h"), F.sum("one").alias("one"))
    root = rows.agg(F.count("*").alias("n"), F.first("h").alias("h"), F.sum("one").alias("one")).select(F.when(F.col("n") <= 1, F.col("h")).otherwise(F.raise_error(F.lit("more documents than the tree holds"))).alias("sha256"), F.coalesce("one", F.lit(0)).cast("long").alias("documents"))
    return root


def replay(decoded: DataFrame, stored: DataFrame) -> DataFrame:
    """(documents, same, missing, added): documents of both sides, those with the very same spans (doc_id, start, end,
    label), and spans that one side lacks. The gate is open if ``missing`` and ``added`` are 0."""
    key = ["doc_id", *SPANS]
    side = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n))
    both = side(decoded, "a").join(side(stored, "b"), key, "full_outer").fillna(0, ["a", "b"])
    per = both.groupBy("doc_id").agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("m"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("x"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(F.count("*").alias("documents"), F.count_if((F.col("m") == 0) & (F.col("x") == 0)).alias("same"), zero("m").alias("missing"), zero("x").alias("added"))


def scaling_audit(docs: DataFrame, gold_of: Callable[[dict], list[tuple[int, int, int]]], beta: float) -> DataFrame:
    """(doc_id, k, map_kept, nll, nll_scaled, map_correct, mbr_correct, mbr_scaled_correct) of lattices (n, a, b, energies, k).

    The likeliest structure must stay when energies are multiplied by ``beta``; the negative log likelihoods of gold are a slot's.
    """

    def kernel(row: dict) -> list[dict]:
        k, gold = int(row["k"]), gold_of(row)
        one = Lattice(int(row["n"]), np.stack([row["a"], row["b"]], axis=1), row["energies"])
        scaled = Lattice(one.n, one.pairs, one.energies * beta)
        first, second = slot_mbr(one, k), slot_mbr(scaled, k)
        place = {(int(a), int(b)): i for i, (a, b) in enumerate(one.pairs)}
        energy = sum(float(one.energies[place[a, b], x]) for a, b, x in gold) if all((a, b) in place for a, b, _ in gold) else None
        loss = lambda decoded, scale: None if energy is None else (decoded.log_z - scale * energy) / max(1, k)
        right = lambda chosen: sum(x == y for x, y in zip(chosen, gold, strict=False))
        return [{"doc_id": row["doc_id"], "k": k, "map_kept": first.map == second.map, "nll": loss(first, 1.0), "nll_scaled": loss(second, beta), "map_correct": right(first.map), "mbr_correct": right(first.mbr), "mbr_scaled_correct": right(second.mbr)}]

    return per_document(docs, kernel, "doc_id long, k int, map_kept boolean, nll double, nll_scaled double, map_correct int, mbr_correct int, mbr_scaled_correct int")


def decode_scores(docs: DataFrame, tau: float = 1.0) -> DataFrame:
    """(doc_id, slot, start, end, label): least-risk spans in characters from scores. ``docs``: n, a, b, logits (per
    interval: none, then the labels), k, bounds (start and end of each token)."""
    from quillspan.operators.scoring import logits_to_energies

    def kernel(row: dict) -> list[dict]:
        lattice = Lattice(int(row["n"]), np.stack([row["a"], row["b"]], axis=1), logits_to_energies(np.asarray(row["logits"])))
        bounds = row["bounds"]
        spans = sorted((bounds[a]["start"], bounds[b - 1]["end"], LABELS[x]) for a, b, x in slot_mbr(lattice, int(row["k"]), tau).mbr)
        return [{"doc_id": row["doc_id"], "slot": i, "start": a, "end": b, "label": x} for i, (a, b, x) in enumerate(spans, 1)]

    return per_document(docs, kernel, "doc_id long, slot int, start int, end int, label string")


class Stages:
    """Steps that run in order, each on evidence: the digests of what the steps before have written.

    ``steps``: (name, make), ``make`` from the paths of the earlier steps to a DataFrame. Each result is published
    once under ``root``; a step that is done is verified instead of run, and one whose forerunner has changed since is refused.
    """

    def __init__(self, spark: SparkSession, root: str, steps: list[tuple[str, Callable[[dict[str, str]], DataFrame]]]):
        self.spark, self.root, self.steps = spark, root.rstrip("/"), steps

    def run(self) -> dict[str, str]:
        """The paths of all steps' results."""
        done: dict[str, str] = {}
        for name, make in self.steps:
            path, evidence = f"{self.root}/{name}", dict(done)
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
                stated = artifacts.check_build(self.spark, path)["sources"]
                if stated != {n: artifacts.digest(self.spark, p) for n, p in evidence.items()}:
                    raise artifacts.ArtifactError(f"{name} was made from something else")
            else:
                artifacts.publish(self.spark, {name: make(dict(done))}, path, sources=evidence)
            done[name] = f"{path}/{name}.parquet"
        return done


def prediction_slots(predictions: DataFrame) -> DataFrame:
    """(doc_id, predicted): spans (doc_id, start, end, label) gathered by document, in order."""
    return predictions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*SPANS))).alias("predicted"))
