"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks, queries into groups; every group meets every block in one task. Blocks
and groups are as large as a task may hold (TILE_BYTES each), since every vector is sent once per
group and every query once per block; below that there are as many as keep all tasks busy. For
a block, the components of each dimension are sorted once. A query walks all lists at once from the
end that its sign favours, scores the vectors it meets, and stops when the sum of what the lists
offer at this depth is below its k-th best score: no vector further down can get in. Each task
returns at most k rows per query, and the best k of all blocks remain.

Rows: vectors that are null or hold null or non-finite components, and rows without an id, take no
part. Repeated rows with equal id and vector count once, and vectors under a query's own id are not
its candidates. A query meets the vectors of its own number of components. Extra columns are left
out; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hibiki.llm.common import prepare
from hibiki.operators.ranking import best_per_key
from hibiki.session import write_out

#: Bytes of the vectors of a block and of the queries of a group, as doubles.
TILE_BYTES = 32 << 20
#: Rows that are not dealt any finer.
LEAST_ROWS = 1024
FIRST_DEPTH = 8


def search_block(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """For each query (position, ids, scores): its k best of the block, by the threshold algorithm."""
    count, size = vectors.shape
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(size, 1)
    if largest < 2 ** 53:  # whole numbers below this are exact as doubles, and much faster
        vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
    order = np.argsort(vectors, axis=0, kind="stable")
    lists = np.take_along_axis(vectors, order, axis=0)
    for position, query in enumerate(queries):
        rising = query < 0
        met = np.zeros(count, bool)
        met[ids == own[position]] = True
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
        shallow, depth = 0, FIRST_DEPTH
        while True:
            depth = min(depth, count)
            part = np.where(rising, order[shallow:depth], order[count - depth:count - shallow])
            new = np.zeros(count, bool)
            new[part.ravel()] = True
            new &= ~met
            met |= new
            if depth == count:  # also what vectors without components need
                new |= ~met
            rows = np.flatnonzero(new)
            best_ids = np.concatenate([best_ids, ids[rows]])
            best = np.concatenate([best, vectors[rows] @ query])
            if len(best) > k:
                first = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[first], best[first]
            if depth == count or met.all():
                break
            bound = query @ np.where(rising, lists[depth - 1], lists[count - depth])
            if len(best) == k and bound < best.min():
                break
            shallow, depth = depth, depth * 4
        yield position, best_ids, best


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) for every component; null for vectors that take no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    block: int | None = None, group: int | None = None,
) -> DataFrame:
    """query_id, rank, ``key`` and score of the k best vectors of every query.

    Ties go to the smaller id. Vectors are arrays of whole numbers. ``block`` and ``group``: rows of
    a block and of a group; unset, as many as TILE_BYTES hold, or as the shuffle partitions ask for.
    """
    spark = prepare(vectors.sparkSession)
    all_rows = write_out(_usable(vectors, key, vector), "vectors")
    asked = write_out(_usable(queries, key, vector), "queries")
    (vectors_in, longest), (queries_in, _) = _extent(all_rows), _extent(asked)
    if not vectors_in or not queries_in:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = _parts(queries_in, longest, group, 1)
    blocks = _parts(vectors_in, longest, block, -(-tasks // groups))
    to_block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    to_group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    stored = all_rows.select("id", "v", F.size("v").alias("d"), to_block.alias("block")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    asking = asked.select("id", "v", F.size("v").alias("d"), to_group.alias("group")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, table = _matrix(left)
            own, query = _matrix(right)
            for position, best_ids, best in search_block(ids, table, query, own, k):
                found[0].append(np.full(len(best), own[position]))
                found[1].append(best_ids)
                found[2].append(best.astype(np.int64))
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
        return pa.table(columns, ["query_id", key, "score"])

    met = (
        stored.groupBy("d", "block", "group").cogroup(asking.groupBy("d", "block", "group"))
        .applyInArrow(run, f"query_id long, {key} long, score long")
    )
    ranked = best_per_key(met, ["query_id"], [F.col("score").desc(), F.col(key)], k)
    return ranked.select("query_id", "rank", key, "score")


def _extent(rows: DataFrame) -> tuple[int, int]:
    """The number of rows, and the largest number of components."""
    return tuple(rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first())


def _parts(rows: int, components: int, size: int | None, wanted: int) -> int:
    """Into how many parts so many rows are dealt: of ``size`` rows, or at least ``wanted``."""
    if size is not None:
        return -(-rows // size)
    held = max(LEAST_ROWS, TILE_BYTES // (8 * max(components, 1)))
    return max(-(-rows // held), min(wanted, -(-rows // LEAST_ROWS)))


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.dropna().dropDuplicates(["id", "v"])


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = rows.column("v").combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.column("id").to_numpy(), flat.reshape(rows.num_rows, -1)
