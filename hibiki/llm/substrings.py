"""Removal of word sequences that occur earlier, found by recompression.

Words become symbols, named by hashes that are the same on every executor. A round names runs of
two equal symbols, a second one pairs whose left symbol is a "left" and whose right one is a
"right" by a coin that their names toss. Whether symbols merge depends on at most REACH words
around, so equal windows of words hold equal symbols between their REACH-word margins, and at
least two whole ones. Each window picks one of them, its anchor: the best by a rank of names.
The anchor's symbol, extended to the margins, names a longer run of words that every window around
the anchor holds; windows can be equal only where these high-level symbols are shared.

Spark counts the high-level symbols and keeps the shared ones, which only propose repeats. What is
accepted is verified by the words themselves: by a SHA-256 digest (its first 128 bits) of the words
of the whole stretch that a symbol's windows cover. Stretches equal to an earlier one are repeats
as a whole. For the first occurrence of each stretch whose symbol has other stretches, too, which is
the edge of a repeat, the windows themselves are compared in the same way. So two texts whose words
got one name by chance never lose a word.

Rows: null texts have no words. Earlier means a smaller key, or the same key and an earlier start;
null keys are smaller than any. Repeated rows with equal key and text are one document: none is
earlier than the other, and all get the same result. Texts under one key are told apart by their
hash. Texts shorter than a window stay whole. Extra columns are left out; empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hibiki.llm.common import Runs, mix, prepare, text_bytes, word_names, word_spans
from hibiki.session import write_out

WINDOW = 20
REACH = 4  # words: two for runs of two, two more for pairs of such
SPAN = 4  # words in a symbol, at most
_WINDOWS = 1 << 16  # windows digested at once
#: Documents whose keys may be broadcast, so that only their texts are shuffled.
BROADCAST_DOCS = 500_000


def _merge(names, starts, ends, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after each symbol marked in ``joined`` has swallowed the next one."""
    at = np.flatnonzero(joined)
    names = names.copy()
    names[at] = mix(names[at] * np.uint64(3) + mix(names[at + 1]))
    ends = ends.copy()
    ends[at] = ends[at + 1]
    keep = np.ones(len(names), bool)
    keep[at + 1] = False
    return names[keep], starts[keep], ends[keep]


def recompress(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and ends (in words) of the symbols after both rounds; texts stay apart."""
    starts = np.arange(len(words))
    ends = starts + 1
    begin = np.zeros(len(words) + 1, bool)
    begin[first] = True
    begin[-1] = True
    same = np.zeros(len(words) + 1, bool)  # whether a word equals the one before it
    same[1:-1] = words[1:] == words[:-1]
    same &= ~begin
    # The first of a run of exactly two.
    twice = ~same[:-1] & same[1:]
    twice[:-1] &= ~same[2:]
    names, starts, ends = _merge(words, starts, ends, twice)
    left = mix(names) & np.uint64(1) == 0
    pair = np.zeros(len(names), bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~begin[starts[1:]]
    return _merge(names, starts, ends, pair)


def anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW):
    """Per anchor: first and last start of the windows that picked it, its symbol's start and end."""
    none = np.zeros(0, np.int64)
    lengths = np.diff(first)
    count = np.maximum(lengths - window + 1, 0)
    if not count.sum():
        return none, none, none, none
    names, starts, ends = recompress(words, first)
    text = np.repeat(np.arange(len(lengths)), count)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][text]
    # Longer symbols first: they are rarer.
    rank = (mix(names + np.uint64(1)) >> np.uint64(1)) | ((ends - starts == 1).astype(np.uint64) << np.uint64(63))
    whole = np.searchsorted(starts, begin + REACH)
    best = whole.copy()
    limit = begin + window - REACH
    for k in range(1, window - 2 * REACH):
        other = np.minimum(whole + k, len(starts) - 1)
        better = (ends[other] <= limit) & (rank[other] < rank[best])
        best[better] = other[better]
    turn = np.ones(len(best), bool)
    turn[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(turn)
    upto = np.append(at[1:], len(best)) - 1
    return begin[at], begin[upto], starts[best[at]], ends[best[at]]


class Words:
    """The words of some texts: their bytes, joined by single spaces, and the first word of each text."""

    def __init__(self, column: pa.Array):
        self.data, offsets = text_bytes(column)
        self.starts, self.ends, self.first = word_spans(self.data, offsets)
        lengths = self.ends - self.starts
        #: Where each word begins in the joined bytes, and the end of all.
        self.at = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.at[1:])
        joined = np.full(self.at[-1], 32, np.uint8)
        letters = (self.data != 32) & ((self.data < 9) | (self.data > 13))
        # Each letter moves on by one space for every word before its own.
        joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = self.data[letters]
        self.joined = memoryview(joined)

    def names(self) -> np.ndarray:
        return word_names(self.data, self.starts, self.ends)

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """128 bits of SHA-256 of the words of each non-empty span."""
        spans = zip(self.at[starts].tolist(), (self.at[ends] - 1).tolist())
        return pa.array([hashlib.sha256(self.joined[a:b]).digest()[:16] for a, b in spans], pa.binary())


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(symbol, words, d, h, lo, n): high-level symbol, digest of the words of the stretch of its
    windows, and where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(2))
            names, first = words.names(), words.first
            lo, hi, start, end = anchors(names, first, window)
            symbol = Runs(names, SPAN + 2 * REACH).names(start - REACH, end + REACH).view(np.int64)
            text = np.searchsorted(first, lo, "right") - 1
            for i in range(0, len(lo), 1 << 16):
                part = slice(i, i + (1 << 16))
                rows = pa.array(text[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(symbol[part]), words.digests(lo[part], hi[part] + window),
                     batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array((lo - first[text])[part].astype(np.int32)),
                     pa.array((hi - lo + 1)[part].astype(np.int32))],
                    ["symbol", "words", "d", "h", "lo", "n"],
                )

    return docs.select("d", "h", "text").mapInArrow(
        run, "symbol long, words binary, d long, h long, lo int, n int"
    )


def _window_rows(asked: DataFrame, window: int) -> DataFrame:
    """(symbol, words, d, h, lo): digests of the windows asked for. ``asked``: d, h, text, parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(2))
            parts = batch.column(3)
            counts = np.diff(parts.offsets.to_numpy())
            fields = parts.flatten()
            lo, n = (fields.field(k).to_numpy().astype(np.int64) for k in ("lo", "n"))
            symbol = fields.field("symbol").to_numpy()
            text = np.repeat(np.arange(batch.num_rows), counts)
            upto = np.cumsum(n)
            # Some windows at a time: a batch may ask for all windows of very long texts.
            for a in range(0, int(n.sum()), _WINDOWS):
                each = np.arange(a, min(a + _WINDOWS, int(upto[-1])))
                part = np.searchsorted(upto, each, "right")
                begin = lo[part] + each - (upto[part] - n[part])
                at = begin + words.first[text[part]]
                rows = pa.array(text[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(symbol[part]), words.digests(at, at + window), batch.column(0).take(rows),
                     batch.column(1).take(rows), pa.array(begin.astype(np.int32))],
                    ["symbol", "words", "d", "h", "lo"],
                )

    return asked.select("d", "h", "text", "parts").mapInArrow(
        run, "symbol long, words binary, d long, h long, lo int"
    )


def _later(rows: DataFrame, *names: str) -> DataFrame:
    """Rows that are not the first with their symbol and words."""
    first = rows.groupBy(*names).agg(F.min(F.struct("d", "lo")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = write_out(first.filter("n > 1").drop("n"), "first-windows")
    return rows.join(first, list(names)).filter(F.struct("d", "lo") > F.col("first"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, h, lo, n): starts lo, lo + 1, ... of n windows that occur earlier. ``docs``: d, h, text."""
    found = _anchor_rows(docs, window)
    # Written, so that a hot symbol meets it in a join of two shuffled sides, which can be split.
    shared = write_out(found.groupBy("symbol").count().filter("count > 1").select("symbol"), "shared")
    found = write_out(found.join(shared, "symbol", "left_semi"), "shared-anchors")
    names = ["symbol", "words"]
    firsts = write_out(
        found.groupBy(*names).agg(F.min(F.struct("d", "lo", "h", "n")).alias("first"))
        .select(*names, "first.*"), "stretches",
    )
    same = found.alias("f").join(
        firsts.select(*names, F.struct("d", "lo").alias("first")), names
    ).filter(F.struct("f.d", "f.lo") > F.col("first")).select("d", "h", "lo", "n")
    several = write_out(firsts.groupBy("symbol").count().filter("count > 1").select("symbol"), "several")
    edges = write_out(firsts.join(several, "symbol", "left_semi"), "edges")
    parts = edges.groupBy("d", "h").agg(F.collect_list(F.struct("symbol", "lo", "n")).alias("parts"))
    texts = _only(docs, edges.select("d", "h").distinct()).dropDuplicates(["d", "h"])
    windows = write_out(_window_rows(texts.join(parts, ["d", "h"]), window), "edge-windows")
    late = _later(windows, "symbol", "words").select("d", "h", "lo", F.lit(1).alias("n"))
    return same.unionByName(late)


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of some documents. Where their keys are few enough to be broadcast, the others
    are left out before any shuffle; else the join that follows sees to it."""
    if wanted.count() <= BROADCAST_DOCS:
        return docs.join(F.broadcast(wanted), ["d", "h"], "left_semi")
    return docs


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, n_words, n_removed and ``kept``, the words left, joined by one space."""
    prepare(docs.sparkSession)
    # -2 ** 63 stands for a null key.
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"),
        F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(key).alias("key"),
    )
    late = write_out(
        repeats(rows, window).groupBy("d", "h").agg(F.collect_list(F.struct("lo", "n")).alias("late")),
        "late-windows",
    )
    ids = late.select("d", "h")
    if ids.count() <= BROADCAST_DOCS:
        ids = F.broadcast(ids)
        hit = rows.join(ids, ["d", "h"], "left_semi").join(late, ["d", "h"])
        clean = rows.join(ids, ["d", "h"], "left_anti").withColumn(
            "late", F.lit(None).cast("array<struct<lo:int,n:int>>")
        )
        rows = hit.unionByName(clean)
    else:
        rows = rows.join(late, ["d", "h"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            parts = batch.column(2)
            spans = parts.offsets.to_numpy().tolist()
            lo, n = (parts.values.field(k).to_numpy().astype(np.int64) for k in ("lo", "n"))
            for i, whole in enumerate(batch.column(1)):
                found = whole.as_py().encode().split()
                left, own = found, slice(spans[i], spans[i + 1])
                if spans[i] < spans[i + 1]:
                    gone = np.zeros(len(found) + 1, np.int64)
                    np.add.at(gone, lo[own], 1)
                    np.add.at(gone, lo[own] + n[own] + window - 1, -1)
                    left = [w for w, g in zip(found, np.cumsum(gone).tolist()) if not g]
                words.append(len(found))
                removed.append(len(found) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                [key, "n_words", "n_removed", "kept"],
            )

    own = docs.schema[key].dataType.simpleString()
    return rows.select("key", "text", "late").mapInArrow(
        run, f"`{key}` {own}, n_words long, n_removed long, kept string"
    )
