"""Byte-level BPE as a monoid tree reduction.

A text is cut in halves down to short leaves; a leaf is encoded on its own, and two neighbours are joined
by re-encoding a window over their border. The window starts and ends where the tokens outside provably
stay: at a word's last character before a space or newline. No alternative of the pre-token pattern takes
a non-space and a later white space in one match, and none looks behind, so such a place is a match border
in either half and in the whole, and what lies beyond it is encoded alike. If a window holds no such place
it doubles, in the end to the whole of both halves. Decoding joins the bytes of halves up the tree.

Defined results: a null text is encoded as the empty one (no tokens); very long texts, and words longer
than any window, give the tokens of the whole text; repeated rows each give a row; an empty table gives
an empty table; extra columns pass through ``encode``, one with the new column's name too (the new one then
has underscores added to its own), and are ignored by ``digests``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Characters of a leaf, and of the first window to each side of a border.
LEAF, WINDOW = 1024, 48
#: Rows whose ids are held at once.
ROWS = 128
#: A character that is surely no white space, before a space or newline.
_BORDER = re.compile("[!-~À-ɏ](?=[ \n])")
_CODECS: dict[bytes, "Codec"] = {}


class Codec:
    """Encodes and decodes by a table of ranks and a pre-token pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.bytes = {v: k for k, v in table.items()}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, c: int) -> list[int]:
        if c - a <= LEAF:
            return self.leaf(text[a:c])
        m = (a + c) // 2
        return self._join(text, a, m, c, self._encode(text, a, m), self._encode(text, m, c))

    def _join(self, text: str, a: int, m: int, c: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of text[a:c] from those of text[a:m] and text[m:c]."""
        if not left or not right:
            return self.leaf(text[a:c])
        p, q = self._before(text, a, m), self._after(text, m, c)
        keep = left[: len(left) - len(self.leaf(text[p:m]))]
        return keep + self.leaf(text[p:q]) + right[len(self.leaf(text[m:q])) :]

    @staticmethod
    def _before(text: str, a: int, m: int) -> int:
        """The last sure border inside text[a:m], its white space included there; else a."""
        width = WINDOW
        while True:
            low = max(a, m - width)
            last = None
            for last in _BORDER.finditer(text, low, m):
                pass
            if last is not None or low == a:
                return last.end() if last is not None else a
            width *= 2

    @staticmethod
    def _after(text: str, m: int, c: int) -> int:
        """The first sure border inside text[m:c]; else c."""
        found = _BORDER.search(text, m, c)
        return found.end() if found else c

    def decode(self, ids) -> bytes:
        return self._decode(ids, 0, len(ids))

    def _decode(self, ids, a: int, c: int) -> bytes:
        if c - a <= 4096:
            return b"".join(map(self.bytes.__getitem__, ids[a:c]))
        m = (a + c) // 2
        return self._decode(ids, a, m) + self._decode(ids, m, c)


def _codec(ranks: bytes, pattern: str) -> Codec:
    key = hashlib.sha1(ranks + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _shipped(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", check: bool = False) -> DataFrame:
    """``docs`` with a column of token ids (array<int>). ``path`` names the ranks, read on the driver.

    With ``check`` all ids are decoded again, and a text that they do not give back fails the job."""
    table = _shipped(docs, path)
    while ids in docs.columns:
        ids += "_"
    rows = docs.withColumn(text, F.col(text).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(table.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                piece, out = b.slice(at, ROWS), []
                for x in piece.column(text):
                    one = x.as_py() or ""
                    out.append(np.array(codec.encode(one), np.int32))
                    if check and codec.decode(out[-1].tolist()) != one.encode():
                        raise ValueError("token ids do not decode to their text")
                ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
                packed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([*piece.columns, packed], [*b.schema.names, ids])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{ids}` array<int>")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again."""
    table = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(table.value, pattern)
        for b in batches:
            n, packed, back = [], [], []
            for x in b.column("text"):
                ids = codec.encode(x.as_py() or "")
                n.append(len(ids))
                packed.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
