"""Near duplicates by SimHash fingerprints that are linked through Golay-code keys.

Two 64-bit fingerprints within two bits of each other are cut into segments of 23, 23 and 18 bits.
However the two bits lie, some segment is equal and its partner in one of the three pairs
(third, first), (second, third), (first, second) differs by at most two bits, so that both
fingerprints share a key: the equal segment with a codeword near its partner. Each distinct
fingerprint gets up to 18 keys; those that meet under a key are compared exactly.

Keys under which many distinct fingerprints meet would make too many comparisons. Those
fingerprints are linked another exact way: each is spread to the 65 words at most one bit away,
and two within two bits share one of these. At most 65 fingerprints can meet in such a word.

Rows: a null or empty text, or one without words, has fingerprint 0 and is linked like any other.
Equal texts share one fingerprint, which is compared once. Rows with a null id belong to
components too; a component's id is its smallest id that is not null (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki.llm.common import once, prepare
from hibiki.llm.components import connected
from hibiki.llm.golay import Golay
from hibiki.session import write_out

MAX_BITS = 2  # what the keys are made for
#: Distinct fingerprints under a key from which on they are linked through their neighbours.
CROWDED = 64
#: Rows of a few numbers each that may be broadcast, so that fewer texts are shuffled.
BROADCAST_ROWS = 500_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles of a text, repeats included."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([
        digest(joined[a:b], 42) for a, b in zip((ends - lengths).tolist(), ends[words - 1:].tolist())
    ], "<u8")


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    return simhash(shingle_hashes(text, words))


def add_fingerprints(
    docs: DataFrame, column: str, words: int = 5, text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The kept columns (all by default) and the fingerprint as a signed number."""
    prepare(docs.sparkSession)
    keep = list(docs.columns if keep is None else keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(
                [fingerprint(t, words) for t in batch.column(len(keep)).to_pylist()], np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints.view(np.int64))], [*keep, column]
            )

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(column, T.LongType())])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _golay_keys(prints: DataFrame) -> DataFrame:
    """(key, fp): up to 18 keys of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = once(("golay",), Golay)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            mask = np.uint64((1 << 23) - 1)
            a, b, c = fp & mask, (fp >> np.uint64(23)) & mask, fp >> np.uint64(46)
            for kind, (equal, near) in enumerate(((c, a), (b, c), (a, b))):
                codes, use = code.keys(near.astype(np.int64))
                rows, columns = np.nonzero(use)
                keys = (np.int64(kind) << 35) | (equal.astype(np.int64)[rows] << 12)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys | codes[rows, columns]), pa.array(fp.view(np.int64)[rows])],
                    ["key", "fp"],
                )

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def _meet(keys: DataFrame) -> DataFrame:
    """Pairs a > b of fingerprints under a common key that differ in few bits."""
    few = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= MAX_BITS
    return (
        keys.alias("l")
        .join(keys.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") > F.col("r.fp")) & few)
        .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    )


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints ``fp`` that differ in at most two bits."""
    keys = write_out(_golay_keys(prints), "golay-keys")
    met = write_out(keys.groupBy("key").count().filter("count > 1"), "golay-counts")
    pairs = _meet(keys.join(met.filter(F.col("count") <= crowded), "key", "left_semi"))
    full = met.filter(F.col("count") > crowded)
    if not full.isEmpty():
        dense = keys.join(full, "key", "left_semi").select("fp").distinct()
        around = F.array(F.lit(0).cast("long"), *[
            F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)
        ])
        spread = dense.select("fp", F.explode(around).alias("flip")).select(
            F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp"
        )
        pairs = pairs.unionByName(_meet(spread))
    return pairs.distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text",
    crowded: int = CROWDED,
) -> DataFrame:
    """Per row of docs: its key, ``fp`` (signed) and ``component_id``."""
    rows = write_out(add_fingerprints(docs, "fp", words, text, [key]), "fingerprints")
    prints = write_out(rows.groupBy("fp").agg(F.min(key).alias("least")), "prints")
    roots = write_out(connected(links(prints, crowded)).withColumnRenamed("node", "fp"), "roots")
    # Written, so that joins on a hot root or fingerprint meet two shuffled sides and can be split.
    least = roots.join(prints, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    least = write_out(least, "component-ids")
    found = (
        prints.join(roots.join(least, "root"), "fp", "left")
        .select("fp", F.coalesce("component_id", "least").alias("component_id"))
    )
    found = write_out(found, "components")
    return rows.join(found, "fp").select(key, "fp", "component_id")


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(
    docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text", crowded: int = CROWDED
) -> DataFrame:
    """The rows with the smallest key of every group that ``near_duplicates`` links, with all columns.

    Among equal keys the smallest content hash stays; of wholly equal rows, one. Rows with a null
    key stay only where the group has no other key. Texts without words are one group. Columns are
    carried in a struct, so that none can clash.
    """
    prepare(docs.sparkSession)
    content = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    own = docs.select(F.col(key).alias("k"), content.alias("c"), F.col(text).alias("t"))
    rows = write_out(add_fingerprints(own, "fp", words, "t", ["k", "c"]), "fingerprints")
    rank = F.struct(F.col("k").isNull().alias("none"), F.col("k"), F.col("c"))
    prints = write_out(rows.groupBy("fp").agg(F.min(rank).alias("first")), "prints")
    roots = write_out(connected(links(prints, crowded)).withColumnRenamed("node", "fp"), "roots")
    tied = prints.join(roots, "fp")
    least = write_out(tied.groupBy("root").agg(F.min("first").alias("least")), "firsts")
    tied = roots.join(least, "root").select("fp", "least")
    firsts = prints.join(tied, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))
    firsts = write_out(firsts, "firsts")
    # Rows are few columns here. What does not simply stay: rows to drop, and equal rows of which one stays.
    each = rows.groupBy("k", "c", "fp").agg(F.count(F.lit(1)).alias("n")).join(firsts, "fp")
    each = each.withColumn("stays", rank.eqNullSafe(F.col("first")))
    others = write_out(each.filter("NOT stays OR n > 1").select("k", "c", "stays"), "others")
    carried = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(key).alias("own"),
                          content.alias("content"))
    same = F.col("own").eqNullSafe(F.col("k")) & (F.col("content") == F.col("c"))
    single = carried.join(_small(others), same, "left_anti")
    equal = carried.join(_small(others.filter("stays")), same, "left_semi").dropDuplicates(["own", "content"])
    return single.unionByName(equal).select("row.*")


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast where there are few enough; else the join shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
