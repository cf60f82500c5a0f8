"""Exact top-k by inner product: columnar branch and bound.

Vectors become integers (the floor of ``scale`` times a component) and are held column by column. A block
of queries meets a block of candidates one block of dimensions at a time. What the dimensions still to come
can add is at most the product of the two remaining norms (Cauchy-Schwarz); a pair of query and candidate whose
sum so far and remaining mass stay under the query's floor is given up. While most pairs are open the block is
kept whole, without candidates that no query wants; once few are open they are compacted to a list of pairs, and
only those go on to the next dimensions. Sums are compared by ``>=``, so ties are kept and then settled by
the smaller id.

A query's floor is its present k-th score, or that among the ``PROBE`` longest vectors of the table, which is
known before the candidates are read: so bounds bite from the first block of every task.

The queries are a stated set; they are sent to the candidates in groups of bounded size, one pass over the
candidates a group, whose results are written before the next group is sent. Each task returns its best k of
every query; the last step ranks those.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor does a
row with a null id; vectors of other lengths than the query's are no candidates for it; rows with the
query's own id are its own; repeated rows of a query id give one list (of the first vector in order);
repeated candidate rows each count; fewer candidates than k give all of them; scores are exact integers, above
2^53 too; one that a 64-bit integer cannot hold is given as the nearest that it can; a component that times the scale
is beyond doubles counts as the largest of them; an empty table gives none.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillspan.sources.scratch import fresh_path

K, SCALE, EVERY = 20, 64.0, 20
#: Bytes of query vectors sent at once; vectors of a candidate block; dimensions of a block; queries of a block.
GROUP_BYTES, BLOCK, DIMS, QUERIES = 16 << 20, 4096, 8, 256
#: Vectors that give the first floors; open share of a block below which its pairs are listed.
PROBE, SPARSE = 2048, 0.1
_LONG = np.iinfo(np.int64)


def _valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): rows that take part, as arrays of integers in doubles."""
    v = F.col("v")
    slim = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return slim.where(F.col("vec_id").isNotNull() & v.isNotNull() & good).where(F.size(v) > 0)


def _integers(v: pa.Array, n: int, scale: float) -> np.ndarray:
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)), -most, most)


def _matrices(ids: np.ndarray, column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each length in a batch."""
    lengths = np.asarray(column.value_lengths())
    for n in np.unique(lengths):
        at = np.nonzero(lengths == n)[0]
        yield ids[at], _integers(column.take(pa.array(at)), len(at), scale)


class Search:
    """The best k of each query so far. ``queries``: one row a query, all of one length.

    ``steps`` counts the products of components that were computed, ``full`` those of all pairs."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.k = ids, k
        # dimensions that weigh most first, so that bounds tighten early
        with np.errstate(over="ignore"):
            self.order = np.argsort(-np.square(queries).sum(axis=0), kind="stable")
        self.q = np.ascontiguousarray(queries[:, self.order])
        self.cuts = [*range(0, self.q.shape[1], DIMS), self.q.shape[1]]
        self.q_rest = self._rest(self.q)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), _LONG.max)
        self.warm = np.full(len(ids), -np.inf)
        self.steps = self.full = 0

    def _rest(self, x: np.ndarray) -> np.ndarray:
        """Norms of the dimensions from each cut on: (cuts, rows)."""
        with np.errstate(over="ignore"):
            mass = np.square(x)
        return np.sqrt(np.stack([mass[:, at:].sum(axis=1) for at in self.cuts]))

    def floors(self) -> np.ndarray:
        """A double at most the k-th score of every query, -inf where there are fewer."""
        most = float(np.finfo(np.float64).max)
        return np.nextafter(np.array([s if -most <= s <= most else most if s > 0 else -np.inf for s in self.scores[:, -1].tolist()], dtype=np.float64), -np.inf)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        x = vectors[:, self.order]
        self.full += x.size * len(self.q)
        with np.errstate(over="ignore"):
            peak = np.abs(x).max(initial=0.0) * np.abs(self.q).max(initial=0.0) * x.shape[1]
        if peak >= 2.0**53 or self.scores.dtype == object:  # beyond doubles: whole numbers of any size
            self._exact(ids, x)
            return
        kind = np.float32 if peak < 2.0**24 else np.float64
        rest = self._rest(x)
        x = x.astype(kind)
        columns = [np.ascontiguousarray(x[:, a:b].T) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        q = self.q.astype(kind)
        for at in range(0, len(q), QUERIES):
            self._block(slice(at, at + QUERIES), ids, q[at : at + QUERIES], x, columns, rest)

    def _block(self, rows: slice, ids: np.ndarray, q: np.ndarray, x: np.ndarray, columns: list[np.ndarray], rest: np.ndarray) -> None:
        floor = np.maximum(self.scores[rows, -1], self.warm[rows])
        alive, sums = np.arange(len(ids)), np.zeros((len(q), len(ids)), q.dtype)
        bound = lambda j, s, r, c: s + self.q_rest[j, rows][r] * rest[j, c] * (1 + 1e-6) + 1e-3
        every = (slice(None), None)
        last = len(columns) - 1
        for j, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            sums += q[:, a:b] @ (columns[j] if len(alive) == len(ids) else columns[j][:, alive])
            self.steps += sums.size * (b - a)
            if j == last:
                break
            some = slice(0, 64)  # most blocks are open at first: a few candidates tell
            if (bound(j + 1, sums[:, some], every, alive[some]) >= floor[:, None]).mean() > 0.9:
                continue
            open_ = bound(j + 1, sums, every, alive) >= floor[:, None]
            if open_.mean() < SPARSE:
                r, c = np.nonzero(open_)
                self._pairs(j + 1, rows, ids, q, x, rest, r, alive[c], sums[r, c], floor, bound)
                return
            wanted = open_.any(axis=0)
            if wanted.mean() < 0.7:
                alive, sums = alive[wanted], np.ascontiguousarray(sums[:, wanted])
        r, c = np.nonzero(sums >= floor[:, None])
        self._merge(rows.start, r, ids[alive[c]], sums[r, c])

    def _pairs(self, first: int, rows: slice, ids: np.ndarray, q: np.ndarray, x: np.ndarray, rest: np.ndarray, r: np.ndarray, c: np.ndarray, sums: np.ndarray, floor: np.ndarray, bound) -> None:
        """The dimensions from cut ``first`` on for a list of pairs, compacted at each."""
        for j in range(first, len(self.cuts) - 1):
            a, b = self.cuts[j], self.cuts[j + 1]
            sums = sums + np.einsum("ij,ij->i", q[r, a:b], x[c, a:b])
            self.steps += len(r) * (b - a)
            keep = (bound(j + 1, sums, r, c) if j + 2 < len(self.cuts) else sums) >= floor[r]
            r, c, sums = r[keep], c[keep], sums[keep]
        self._merge(rows.start, r, ids[c], sums)

    def _exact(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.scores = self.scores.astype(object)
        self.steps += x.size * len(self.q)
        whole = [[int(v) for v in row] for row in x.tolist()]
        for i, q in enumerate(self.q.tolist()):
            q = [int(v) for v in q]
            new = [(-sum(a * b for a, b in zip(q, v, strict=True)), int(d)) for d, v in zip(ids, whole, strict=True) if d != self.ids[i]]
            old = [(-s, int(d)) for s, d in zip(self.scores[i], self.found[i], strict=True)]
            best = sorted(old + new)[: self.k]
            for n, (s, d) in enumerate(best):
                self.scores[i, n], self.found[i, n] = -s, d

    def _merge(self, start: int, r: np.ndarray, ids: np.ndarray, sums: np.ndarray) -> None:
        """Takes pairs in order of their query's place ``r``."""
        other = ids != self.ids[start + r]
        r, ids, sums = r[other], ids[other], sums[other]
        cuts = np.concatenate([[0], np.nonzero(np.diff(r))[0] + 1, [len(r)]])
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if low == high:
                continue
            i = start + int(r[low])
            s = np.concatenate([self.scores[i], sums[low:high]])
            d = np.concatenate([self.found[i], ids[low:high]])
            best = np.lexsort((d, -s))[: self.k]
            self.scores[i], self.found[i] = s[best], d[best]

    def result(self) -> pa.RecordBatch:
        """(query_id, vec_id, score) of what was found."""
        i, j = np.nonzero(self.scores != -np.inf)
        scores = self.scores[i, j]
        if scores.dtype == object:
            scores = np.array([min(max(int(s), _LONG.min), _LONG.max) for s in scores], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i], pa.int64()), pa.array(self.found[i, j], pa.int64()), pa.array(scores.astype(np.int64))], ["query_id", "vec_id", "score"])


def _searches(asked: pa.Table, probe: pa.Table, k: int, scale: float) -> list[Search]:
    """A search for each length of the queries, with floors from the probe."""
    if not asked.num_rows:
        return []
    found = {x.shape[1]: Search(i, x, k) for i, x in _matrices(asked.column("vec_id").to_numpy(), asked.column("v").combine_chunks(), scale)}
    if probe.num_rows:
        for ids, x in _matrices(probe.column("vec_id").to_numpy(), probe.column("v").combine_chunks(), scale):
            if x.shape[1] in found:
                own = found[x.shape[1]]
                first = Search(own.ids, own.q[:, np.argsort(own.order)], k)
                first.offer(ids, x)
                own.warm = first.floors()
    return list(found.values())


def top_k(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest score for every query, ties to the smaller id."""
    spark = vectors.sparkSession
    first = Window.partitionBy("vec_id").orderBy("v")
    asked = _valid(queries, vec_id, vector).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    groups = max(1, -(-(size["n"] * (size["d"] or 1) * 8) // GROUP_BYTES))
    rows = _valid(vectors, vec_id, vector)
    mass = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    probe = rows.orderBy(mass.desc(), "vec_id").limit(min(PROBE, max(k, GROUP_BYTES // (8 * (size["d"] or 1))))).toArrow()
    path = fresh_path(spark, "topk")
    for g in range(groups):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toArrow()
        sent = spark.sparkContext.broadcast(_searches(own, probe, k, scale))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = {s.q.shape[1]: copy.deepcopy(s) for s in sent.value}
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    piece = b.slice(at, BLOCK)
                    for ids, x in _matrices(piece.column("vec_id").to_numpy(), piece.column("v"), scale):
                        if x.shape[1] in found:
                            found[x.shape[1]].offer(ids, x)
            yield from (s.result() for s in found.values())

        rows.mapInArrow(run, "query_id long, vec_id long, score long").write.mode("append").parquet(path)
        sent.unpersist()
    every = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every_nth(vectors: DataFrame, n: int = EVERY, vec_id: str = "vec_id") -> DataFrame:
    """The stated query set: rows whose id is divisible by n."""
    return vectors.where(F.col(vec_id) % n == 0)
