"""Byte-level BPE by reduction over a tree.

A text is encoded by halves. Two neighbours are joined by encoding again only a window around
their seam: it grows on either side until it meets a place where a run of non-spaces ends and a
space follows. No match of the tokenizer's pattern crosses such a place, and no match before it
depends on what follows, so all tokens outside the window stay as they are. Joining is
associative, with the empty text as neutral element, and decoding concatenates up the same tree.

Rows: null texts encode to no ids, like empty ones; null ids decode to no bytes. Rows with equal
keys stay separate rows, columns that are not named are left out, empty tables give none.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hibiki.llm.common import once, prepare

LEAF_CHARS = 2048
LEAF_TOKENS = 4096
# A space after what no reading of "white space" takes for one.
_SEAM = re.compile(r"(?<=\S)[ \t-\r]")


class Codec:
    """Encodes and decodes by tree reduction; ``leaf`` is the longest text encoded at once."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf = leaf
        self.base = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.tokens = self.base.encode_ordinary

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.tokens(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._encode(text, a, m), self._encode(text, m, b))

    def _join(self, text, a, m, b, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[a:b] from those of text[a:m] and text[m:b]."""
        lo, hi = seam_before(text, a, m), seam_after(text, m, b)
        cut = len(self.tokens(text[lo:m]))
        left = left[:len(left) - cut]
        left += self.tokens(text[lo:hi])
        left += right[len(self.tokens(text[m:hi])):]
        return left

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return self.base.decode_bytes(ids)
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


def seam_before(text: str, a: int, m: int) -> int:
    """The last seam of text[a:m] (m itself counts), searched in a growing window; else a."""
    width = 32
    while True:
        lo = max(a + 1, m - width)
        found = None
        for found in _SEAM.finditer(text, lo, min(m + 1, len(text))):
            pass
        if found is not None:
            return found.start()
        if lo == a + 1:
            return a
        width *= 2


def seam_after(text: str, m: int, b: int) -> int:
    """The first seam of text[m:b] (m itself counts), searched in a growing window; else b."""
    width = 32
    while True:
        hi = min(b, m + width)
        found = _SEAM.search(text, m, hi)
        if found is not None:
            return found.start()
        if hi == b:
            return b
        width *= 2


def _codec(path: str, pattern: str, leaf: int) -> Codec:
    return once(("bpe", path, pattern, leaf), lambda: Codec(path, pattern, leaf))


def _schema(df: DataFrame, keep: Sequence[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([df.schema[name] for name in keep] + list(fields))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str] = ("doc_id",),
    text: str = "text", leaf: int = LEAF_CHARS,
) -> DataFrame:
    """The kept columns, ``n_tokens``, and ``ids``: little-endian unsigned 32-bit numbers."""
    prepare(docs.sparkSession)
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern, leaf)
        for batch in batches:
            ids = [
                np.array(codec.encode(t), "<u4").tobytes() if t else b""
                for t in batch.column(len(keep)).to_pylist()
            ]
            counts = [len(x) // 4 for x in ids]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                [*keep, "n_tokens", "ids"],
            )

    schema = _schema(docs, keep, T.StructField("n_tokens", T.LongType()),
                     T.StructField("ids", T.BinaryType()))
    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(
    encoded: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str] = ("doc_id",),
    ids: str = "ids",
) -> DataFrame:
    """The kept columns and ``bytes``, what the ids stand for."""
    prepare(encoded.sparkSession)
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern, LEAF_CHARS)
        for batch in batches:
            out = [
                codec.decode(np.frombuffer(x, "<u4").tolist()) if x else b""
                for x in batch.column(len(keep)).to_pylist()
            ]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], [*keep, "bytes"])

    schema = _schema(encoded, keep, T.StructField("bytes", T.BinaryType()))
    return encoded.select(*keep, ids).mapInArrow(run, schema)
