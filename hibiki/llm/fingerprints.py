"""Document fingerprints by locally consistent parsing.

A text is a sequence of characters. On each level, runs of equal symbols become one symbol;
deterministic coin tossing (each symbol is replaced by the place and value of the lowest bit in
which it differs from its predecessor, four times) leaves six labels; symbols whose label is a
local maximum begin a phrase; a phrase is named by a hash of its symbols. Where a phrase begins
depends on a few symbols around it only, so equal substrings get equal names inside, wherever they
lie; phrases of one level are the symbols of the next. The fingerprint keeps the smallest hashes of
the distinct phrase names of several levels; likeness estimates the Jaccard similarity of two sets of names from them (exactly, if both sets are
small enough to be kept whole).

Rows: null texts are empty ones, whose fingerprint is empty (likeness 1 to another empty one, 0 to
any other). Rows follow each other by key, nulls first, then by a hash of the text; repeated rows
are neighbours. A key that many rows share, null too, is cut into ranges of its texts' hashes; rows
with equal key and text stay in one range, where they pass one after the other. Extra columns are
left out, whatever their names. Empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki.llm.common import mix, prepare
from hibiki.session import write_out

LEVEL = 2  # phrases of about nine characters
TOP = 4  # phrases of about a hundred
KEPT = 64
_LEAST = -(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters parsed together; longer texts are parsed alone.
_TOGETHER = 1 << 19


def _toss(symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Place (doubled) and value of the lowest bit in which symbols differ from their predecessors."""
    change = symbols ^ before
    place = np.bitwise_count((change & (~change + change.dtype.type(1))) - change.dtype.type(1))
    value = (symbols >> place.astype(symbols.dtype)) & symbols.dtype.type(1)
    return (2 * place + value.astype(np.uint8)).astype(np.uint8)


def _shifted(values: np.ndarray, firsts: np.ndarray, at_first: np.ndarray) -> np.ndarray:
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[firsts] = at_first
    return before


def _phrases(names: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names and text boundaries of the next level. No text is empty."""
    first = np.zeros(len(names), bool)
    first[begins[:-1]] = True
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    starts = np.flatnonzero(new | first)
    lengths = np.diff(starts, append=len(names))
    names = mix(names[starts] + _STEP * lengths.astype(np.uint64))
    begins = np.searchsorted(starts, begins)
    firsts = begins[:-1]
    labels = _toss(names, _shifted(names, firsts, ~names[firsts]))
    for _ in range(3):
        labels = _toss(labels, _shifted(labels, firsts, labels[firsts] ^ 1))
    after = np.zeros_like(labels)
    after[:-1] = labels[1:]
    last = begins[1:] - 1
    peak = (labels > _shifted(labels, firsts, labels[firsts])) & (labels > after)
    peak[last] = False
    peak[firsts] = True
    starts = np.flatnonzero(peak)
    lengths = np.diff(starts, append=len(names))
    places = np.arange(len(names)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(mix(names + _STEP * (places + 1).astype(np.uint64)), starts)
    return mix(sums + lengths.astype(np.uint64)), np.searchsorted(starts, begins)


def fingerprints(
    texts: Sequence[str], level: int = LEVEL, kept: int = KEPT, top: int = TOP
) -> list[np.ndarray]:
    """The smallest distinct hashes of phrase names of each text, from ``level`` up to ``top``."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    at = 0
    while at < len(full):
        to, size = at, 0
        while to < len(full) and (to == at or size + len(texts[full[to]]) <= _TOGETHER):
            size += len(texts[full[to]])
            to += 1
        part = [texts[i] for i in full[at:to]]
        names = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").astype(np.uint64)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        found = []
        for height in range(1, max(top, level) + 1):
            names, begins = _phrases(names, begins)
            if height >= level:
                # A text that is one phrase has nothing to tell further up.
                own = np.diff(begins) > (0 if height == level else 1)
                texts_of = np.repeat(np.arange(len(part)), np.diff(begins))
                use = own[texts_of]
                found.append((texts_of[use], (names[use] >> np.uint64(32)).astype(np.uint32)))
        of, short = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((short, of))
        of, short = of[order], short[order]
        bounds = np.searchsorted(of, np.arange(len(part) + 1))
        for i, a, b in zip(full[at:to], bounds, bounds[1:]):
            out[i] = np.unique(short[a:b])[:kept]
        at = to
    return out


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Jaccard similarity of the sets behind two fingerprints, estimated from the smallest hashes."""
    union = np.union1d(a, b)[:kept]
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum() / len(union))


def written(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def _starts(docs: DataFrame, key: str, text: str, ranges: int) -> list[tuple]:
    """Where ranges of rows begin, in order: (key, smallest hash of a text, whether the hash counts).

    Ranges follow the keys. A key with more rows than a range should have (null is one, too) is cut
    further, by the hashes of its texts; only such rows' texts are read for that.
    """
    limit = max(1, docs.count() // ranges)
    keys = docs.select(F.col(key).alias("key")).repartitionByRange(ranges, "key")
    per_key = keys.withColumn("range", F.spark_partition_id()).groupBy("key").agg(
        F.min("range").alias("range"), F.count(F.lit(1)).alias("n")
    )
    # Fewer keys than ranges can be that frequent.
    found = write_out(
        per_key.groupBy("range").agg(
            F.min(F.struct("key")).alias("least"),
            F.collect_list(F.when(F.col("n") > limit, F.struct("key", "n"))).alias("hot"),
        ), "range-starts",
    ).collect()
    hot = {row.key: -(-row.n // limit) for r in found for row in r.hot}
    starts = [(r.least.key, _LEAST, False) for r in found if r.least.key not in hot]
    if hot:
        slices = F.coalesce(*[F.when(F.col(key).eqNullSafe(F.lit(k)), n) for k, n in hot.items()])
        rows = docs.select(
            F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("order"),
            slices.alias("slices"),
        ).filter("slices IS NOT NULL")
        nth = F.floor((F.col("order").cast("double") / 2.0 ** 64 + 0.5) * F.col("slices"))
        least = write_out(rows.groupBy("key", nth.alias("nth")).agg(F.min("order").alias("order")), "hot-starts")
        starts += [(r.key, r.order, True) for r in least.collect()]
    return sorted(starts, key=lambda s: (s[0] is not None, s[0] if s[0] is not None else 0, s[1]))


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, tail): rows in partitions by ranges of the key and the text's hash, sorted.

    At the end of each partition follows, marked ``tail``, the row with which the next one begins
    (after the last, the first of all), so that every row meets its successor in one pass.
    """
    starts = _starts(docs, key, text, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.xxhash64("text"))
    if not starts:
        return rows.select("key", "text", F.lit(False).alias("tail"))
    parts, kind = len(starts), docs.schema[key].dataType
    known = F.array(*[
        F.struct(F.lit(k).cast(kind).alias("key"), F.lit(o).cast("long").alias("order"), F.lit(h).alias("exact"))
        for k, o, h in starts
    ])
    upto = F.filter(known, lambda s: F.struct(s["key"], s["order"]) <= F.struct(F.col("key"), F.col("order")))
    rows = rows.withColumn("part", F.size(upto) - 1).withColumn("start", F.get(known, F.col("part")))
    first = F.col("start.key").eqNullSafe(F.col("key")) & (
        ~F.col("start.exact") | (F.col("start.order") == F.col("order"))
    )
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(parts)).alias("part"), F.lit(True).alias("tail"))
    places = F.when(first, F.array(own, before)).otherwise(F.array(own))
    placed = rows.select("key", "text", "order", F.explode(places).alias("to"))
    placed = placed.select("key", "text", "order", F.col("to.part").alias("part"), F.col("to.tail").alias("tail"))
    return placed.repartitionById(parts, "part").sortWithinPartitions(
        "part", "tail", F.col("key").asc_nulls_first(), "order"
    ).select("key", "text", "tail")


def compare_neighbours(
    docs: DataFrame, key: str = "doc_id", text: str = "text", level: int = LEVEL, kept: int = KEPT
) -> DataFrame:
    """Per row: key, n_chars, fingerprint, that of the edited text, its sha256, and two likenesses.

    The edited text has its last quarter replaced by the beginning of the next row's text.
    """
    prepare(docs.sparkSession)
    fields = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ])

    def compared(keys: list, texts: list[str]) -> pa.RecordBatch:
        """Rows for all texts but the last, which only follows."""
        quarters = [len(t) // 4 for t in texts]
        edited = [t[:len(t) - q] + n[:q] for t, n, q in zip(texts, texts[1:], quarters)]
        own, other = fingerprints(texts, level, kept), fingerprints(edited, level, kept)
        return pa.RecordBatch.from_arrays([
            pa.array(keys, key_type), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(list(map(written, own[:-1]))), pa.array(list(map(written, other))),
            pa.array([likeness(a, b, kept) for a, b in zip(own, other)]),
            pa.array([likeness(a, b, kept) for a, b in zip(own, own[1:])]),
        ], fields.names)

    key_type = {"bigint": pa.int64(), "int": pa.int32()}.get(
        docs.schema[key].dataType.simpleString(), pa.string()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts = [], []
        for batch in batches:
            for k, t, tail in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if tail and not texts:
                    continue  # equal keys: only the first follows
                keys.append(k)
                texts.append(t)
                if tail:
                    yield compared(keys[:-1], texts)
                    keys, texts = [], []
            if len(texts) > 1:
                yield compared(keys[:-1], texts)
                keys, texts = keys[-1:], texts[-1:]

    return in_order(docs, key, text).mapInArrow(run, fields)
