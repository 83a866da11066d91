"""Near duplicates among vectors, by quantised random projections and exact cosines.

Vectors of unit length with a cosine of at least ``similarity`` lie within a distance ``r``. In each
of several tables, a few random directions, each with a random shift, cut space into slabs that are
some multiple of ``r`` wide (Gaussian directions: the projected difference of two vectors is
normal, whatever the vectors are). Vectors in the same slab of all directions of a table share its
bucket. From the chance that two vectors at distance ``r`` share a bucket follows the number of
tables, so that at most one in a thousand of such pairs meets in none; closer pairs are missed less
often still. The number of directions follows from the number of vectors, so that unrelated vectors
fill a bucket up to a given size, however many there are.

All pairs of a bucket are compared by their exact cosines, in double precision. Buckets are cut into
blocks, and one task compares two blocks, so that memory stays bounded however many vectors meet.
Pairs never leave a task: it returns how many links each vector has, counting a pair only in the
first of the tables where it meets, and a spanning forest of the links.

Rows: equal vectors are compared once and count as often as they come, so copies are never paired.
Vectors that are null, zero, or hold null or non-finite components, link with nothing. Vectors of
different length (number of components) do not link. Rows with a null id take part, a component's
id is its smallest id that is not null; rows with equal ids are rows of their own. An empty table
gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hibiki.llm.common import mix, once, prepare
from hibiki.llm.components import connected
from hibiki.session import write_out

SIMILARITY = 0.9
#: Pairs at just that similarity that meet in no table.
MISS = 1e-3
#: Width of a slab, in distances of two vectors of just that similarity.
WIDTH = 4.5
#: Unrelated vectors that share a bucket, about.
CROWD = 1024
#: Vectors of a block; a task compares two blocks.
BLOCK = 2048
SEED = 11


def collision(distance: float, width: float) -> float:
    """The chance that two points at a distance share a slab of a random direction."""
    t = width / distance
    normal = math.erf(t / math.sqrt(2))
    return normal - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


class Tables:
    """The directions and shifts of all tables, and the keys they give to vectors."""

    def __init__(self, rows: int, size: int, similarity: float, miss: float, crowd: int, seed: int):
        radius = math.sqrt(max(2 - 2 * similarity, 1e-12))
        self.width = WIDTH * radius
        far = collision(math.sqrt(2), self.width)
        self.directions = max(1, int(math.log(max(rows / crowd, 1)) / -math.log(far)))
        near = collision(radius, self.width) ** self.directions
        self.tables = max(1, math.ceil(math.log(miss) / math.log1p(-near)))
        self._made = (size, seed)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One 64-bit key per vector and table."""
        size, seed = self._made
        count = self.directions * self.tables

        def make() -> tuple[np.ndarray, np.ndarray]:
            random = np.random.default_rng([seed, size])
            return random.standard_normal((size, count)), random.random(count) * self.width

        across, shift = once(("slabs", size, seed, count, self.width), make)
        slabs = np.floor((unit @ across + shift) / self.width).astype(np.int64).view(np.uint64)
        slabs = slabs.reshape(len(unit), self.tables, self.directions)
        key = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64), slabs.shape[:2])
        for i in range(self.directions):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slabs[:, :, i])
        return key.view(np.int64)


def forest(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Positions of links that connect all that the links (a, b) connect, without a cycle."""
    label, kept = np.arange(count), []
    left = np.arange(len(a))
    while len(left):
        x, y = label[a[left]], label[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        high, first = np.unique(np.maximum(x, y), return_index=True)
        kept.append(left[first])
        onto = np.arange(count)
        onto[high] = np.minimum(x, y)[first]
        while True:
            further = onto[onto]
            if (further == onto).all():
                break
            onto = further
        label = onto[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def usable(vector: Column) -> Column:
    """Whether a vector can link at all."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to unit length."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _keys(vectors: DataFrame, tables: Tables, column: str) -> DataFrame:
    """(node, v, key): every vector under the key of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = tables.keys(_units(batch.column(1)))
            rows = pa.ListArray.from_arrays(
                pa.array(np.arange(len(keys) + 1) * tables.tables, pa.int32()), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], ["node", "v", "copies", "keys"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("node", "v", "copies").mapInArrow(
        run, f"node long, v {kind}, copies long, keys array<long>"
    ).select("node", "v", "copies", F.posexplode("keys").alias("table", column))


def _compared(vectors: DataFrame, tables: Tables, similarity: float, block: int) -> DataFrame:
    """(a, links) of the tasks' counts, and (a, b) of their forests, in one table (b null for counts)."""
    spread = _keys(vectors, tables, "key")
    crowds = write_out(
        spread.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets"
    )
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A vector meets every block of its bucket, its own one included.
    dealt = (
        spread.join(crowds.select("table", "key", blocks.alias("blocks")), ["table", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("table", "key", "node", "v", "copies", "own",
                F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        nth = table.column("table")[0].as_py()
        nodes, copies = (table.column(c).to_numpy() for c in ("node", "copies"))
        unit = _units(table.column("v"))
        blocks = table.column("own").to_numpy()
        left = np.flatnonzero(blocks == low)
        right = left if low == high else np.flatnonzero(blocks == high)
        alike = unit[left] @ unit[right].T >= similarity
        if low == high:
            alike = np.triu(alike, 1)
        a, b = np.nonzero(alike)
        a, b = left[a], right[b]
        if nth and len(a):  # met before?
            met, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = tables.keys(unit[met])
            one, two = at[:len(a)], at[len(a):]
            fresh = np.arange(len(a))
            for t in range(nth):
                fresh = fresh[keys[one[fresh], t] != keys[two[fresh], t]]
            a, b = a[fresh], b[fresh]
        found = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
        some = np.flatnonzero(found)
        tied = forest(a, b, len(nodes))
        none = np.zeros(len(some), np.int64)
        return pa.table({
            "a": np.concatenate([nodes[some], nodes[a[tied]]]),
            "b": pa.array(np.concatenate([none, nodes[b[tied]]]),
                          mask=np.arange(len(some) + len(tied)) < len(some)),
            "links": np.concatenate([found[some].astype(np.int64), np.zeros(len(tied), np.int64)]),
        })

    return dealt.groupBy("table", "key", "low", "high").applyInArrow(run, "a long, b long, links long")


def near_duplicates(
    vectors: DataFrame, similarity: float = SIMILARITY, key: str = "vec_id", vector: str = "embedding",
    miss: float = MISS, crowd: int = CROWD, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """Per row: its key, ``n_links`` (other rows linked directly), ``component_id`` and ``kept``."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    rows = rows.withColumn("size", F.when(usable(F.col("v")), F.size("v")))
    classes = rows.filter("size IS NOT NULL").groupBy("v").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("size").alias("size")
    )
    classes = write_out(classes.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    found = spark.createDataFrame([], "a long, b long, links long")
    # Hardly ever more than one: vectors of other lengths lie in spaces of their own.
    for size, count in sorted(tuple(r) for r in classes.groupBy("size").count().collect()):
        tables = Tables(count, size, similarity, miss, crowd, seed)
        found = found.unionByName(_compared(classes.filter(F.col("size") == size), tables, similarity, block))
    found = write_out(found, "links")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected(found.filter("b IS NOT NULL").select("a", "b"))
    known = (
        classes.select("node", "v", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    known = write_out(known, "linked")
    firsts = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(firsts, "root").select(
        F.col("v").alias("same"), "component_id",
        (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
    )
    all_rows = rows.withColumn("same", F.when(F.col("size").isNotNull(), F.col("v")))
    one = all_rows.join(known, "same", "left")
    component = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return one.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
