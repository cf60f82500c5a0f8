"""Alignment of two tokenizers' tokens by the bytes they stand for.

A text's bytes get one label each: 0 no token ends here, 1 one of A, 2 one of B, 3 one of each. A regular expression
scans the labels and takes a span up to each 3; its 1s and 2s, with the closing 3 counted for both, are the numbers of
A and B tokens in that group. Where nothing inside a group ends together, each label above 0 closes a stretch that lies
in one token of A and one of B, so these stretches are the links, the pairs of tokens whose bytes overlap.

How often a pair of ids is linked in the corpus is counted by Spark from each document's distinct links. To give the
counts back to the documents, pairs that hold at least one in ``SHARE`` of all links (so ``SHARE`` at most, by
definition) are broadcast; the rarer ones, none of which holds more than that share of the rows, meet their documents
by shuffle.

Defined results: a text that is null or empty, or whose tokens of A or B do not join to the bytes of space + text (as
with a U+2581 of its own), has no tokens: zeros and an empty string; texts are encoded whole, whatever their length; repeated
rows each give a row and count each; an empty table gives an empty one; extra columns are ignored, as only the id
comes along.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspan.sources.scratch import materialize

#: Pairs with at least this part of all links are broadcast.
SHARE = 1 << 18
#: Rows whose results are held at once, and kinds of spans whose counts are kept.
ROWS, KNOWN = 128, 1 << 16
_SPAN = re.compile(rb"[^3]*3")
_CODECS: dict[bytes, tuple] = {}

LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])


class ByteLevel:
    """A byte-level BPE vocabulary file of the tokenizers library, run by tiktoken, which gives the same ids several times faster.

    That needs ids in the order of the merges; another file is refused. Strings of special tokens are plain text."""

    def __init__(self, file: bytes, pattern: str):
        import tiktoken

        held = json.loads(file)
        special = {x["content"] for x in held["added_tokens"]}
        vocabulary, merges = held["model"]["vocab"], held["model"]["merges"]
        joined = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if any(a >= b for a, b in zip(joined, joined[1:], strict=False)) or (joined and joined[0] < 256):
            raise ValueError("the ids are not in the order of the merges")
        ranks = {bytes(map(self.letters().__getitem__, k)): v for k, v in vocabulary.items() if k not in special}
        self._encode = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = {v: k for k, v in ranks.items()}

    @staticmethod
    def letters() -> dict[str, int]:
        """The byte that each letter of a byte-level entry stands for: printable Latin-1 itself, the others from U+0100 on, in order."""
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
        return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def encode(self, text: str) -> list[int]:
        return self._encode(" " + text)


class Pieces:
    """A sentencepiece model, which puts the space before the text itself."""

    def __init__(self, file: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.encode = model.encode
        self.bytes = {i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))}


class Aligner:
    """Tokens, groups and links of one text at a time."""

    def __init__(self, a, b):
        if b"" in a.bytes.values() or b"" in b.bytes.values():
            raise ValueError("a token stands for no byte")
        self.encode = (a.encode, b.encode)
        self.bytes = tuple([x.bytes.get(i, b"") for i in range(max(x.bytes) + 1)] for x in (a, b))
        self.lengths = tuple(np.array(list(map(len, table)), np.int64) for table in self.bytes)
        # what is written for a token, its id and what follows it: of A, of A at a group's end, of B, of B at a group's end
        self.sizes = tuple(map(len, self.bytes))
        self.written = [f"{i}{end}" for size, ends in zip(self.sizes, (",|", ",;"), strict=True) for end in ends for i in range(size)]
        self.counts: dict[bytes, tuple[int, int]] = {}

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The ids of A and B, and the labels of the bytes; nothing where either does not give back space + text."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none, b""
        whole, sides = b" " + text.encode(), []
        labels = np.full(len(whole), 48, np.uint8)
        for mark, encode, table, lengths in zip((1, 2), self.encode, self.bytes, self.lengths, strict=True):
            ids = encode(text)
            if b"".join(map(table.__getitem__, ids)) != whole:
                return none, none, b""
            sides.append(np.array(ids, np.int64))
            labels[lengths[sides[-1]].cumsum() - 1] += mark
        return *sides, labels.tobytes()

    def groups(self, labels: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of A and of B tokens in each group: bytes at which nothing ends are left out, so few spans differ."""
        spans = _SPAN.findall(labels.translate(None, b"0"))
        if len(self.counts) > KNOWN:
            self.counts.clear()
        for s in set(spans) - self.counts.keys():
            self.counts[s] = (s.count(b"1") + 1, s.count(b"2") + 1)
        return tuple(np.array(list(map(self.counts.__getitem__, spans)), np.int64).reshape(-1, 2).T)

    def listed(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
        """The groups as `a1,a2|b1;a3|b2,b3`."""
        out = np.empty(len(a) + len(b), np.int64)
        ends, base = np.cumsum(n_a + n_b), 0
        for ids, n, last, size in ((a, n_a, ends - n_b, self.sizes[0]), (b, n_b, ends, self.sizes[1])):
            stop = np.cumsum(n)
            codes = ids + base
            codes[stop - 1] += size
            out[np.arange(len(ids)) + np.repeat(last - stop, n)] = codes
            base += 2 * size
        return "".join(map(self.written.__getitem__, out.tolist()))[:-1]

    @staticmethod
    def links(a: np.ndarray, b: np.ndarray, labels: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The distinct linked pairs of ids, as a * 2^32 + b, and how often each is linked."""
        ends = np.frombuffer(labels, np.uint8)
        ends = ends[ends > 48] - 48
        left, right = ends & 1, ends >> 1
        pair = a[np.cumsum(left, dtype=np.int64) - left] << 32 | b[np.cumsum(right, dtype=np.int64) - right]
        return np.unique(pair, return_counts=True)


def _aligner(a: bytes, b: bytes, pattern: str) -> Aligner:
    key = hashlib.sha1(a + b + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS[key] = Aligner(ByteLevel(a, pattern), Pieces(b))
    return _CODECS[key]


def _shipped(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), links (a, b, n: the distinct ones) of every text.

    The paths name a byte-level BPE file (A, with its pre-token pattern) and a sentencepiece model (B), read on the driver."""
    a_file, b_file = _shipped(docs, a_path), _shipped(docs, b_path)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file.value, b_file.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece, counts, listed, pairs, times = batch.slice(at, ROWS), [], [], [], []
                for x in piece.column("text"):
                    a, b, labels = aligner.tokens(x.as_py())
                    n_a, n_b = aligner.groups(labels)
                    pair, n = aligner.links(a, b, labels)
                    counts.append((len(a), len(b), len(n_a), int(n.sum())))
                    listed.append(aligner.listed(a, b, n_a, n_b))
                    pairs.append(pair)
                    times.append(n)
                flat, ends = np.concatenate(pairs), pa.array(np.cumsum([0, *map(len, pairs)], dtype=np.int32))
                each = pa.StructArray.from_arrays([pa.array((flat >> 32).astype(np.int32)), pa.array((flat & 0xFFFFFFFF).astype(np.int32)), pa.array(np.concatenate(times).astype(np.int32))], fields=list(LINK))
                columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns, pa.array(listed, pa.string()), pa.ListArray.from_arrays(ends, each)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,n:int>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how often the ids are linked in the corpus, and whether no id of A is linked to b more often."""
    counts = materialize(aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    # one row for each id of B: bounded by its vocabulary
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def report(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's numbers of tokens, groups and links, of links that are their B id's most frequent, the summed counts of its
    links, and a digest of its groups."""
    found = align(docs, a_path, b_path, pattern, text, doc_id)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = materialize(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"), "aligned")
    counts = materialize(pair_counts(rows), "pairs")
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = F.col("count") * F.lit(SHARE) >= F.lit(total)
    links = rows.select("row", F.inline("links"))
    heavy = F.broadcast(counts.where(frequent))
    met = links.join(heavy, ["a", "b"]).unionByName(links.join(heavy, ["a", "b"], "left_anti").join(counts.where(~frequent), ["a", "b"]))
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return rows.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
