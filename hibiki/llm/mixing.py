"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. Keys fall into ranges, and the sums of sizes per source and range
are the distributed prefix sums: they tell in which range each source's budget ends. Only that
range is sorted, to find the key at which the source is cut; a row's copies then follow from its
source's row in a small table, without moving the rows. A source whose target exceeds its size is
repeated: whole epochs first, then the part before the cut.

The row in which the budget ends is taken if at least half of it lies within. Rows with equal id
and text have equal keys and are taken or left together. A null text has size 0, null sources are
one source, the last. A null id is an id like any other. Empty tables give none. Extra columns are
kept by ``mix`` and left out by ``shares``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hibiki.llm.common import WORD, prepare
from hibiki.session import write_out

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
RANGE_ROWS = 4096
#: Sources whose cuts are broadcast; with more, they are joined by a shuffle with skew handling.
BROADCAST_SOURCES = 10_000


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")),
                   F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    # Columns are carried in a struct, so that none can clash.
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(key).alias("key"), size.alias("_size"),
        F.md5(own).alias("_order"), F.col(source).alias("_source"),
    )


def _range(ranges: int) -> Column:
    """The range of a key: equal parts of the space of its first eight hexadecimal digits."""
    head = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    return F.floor(head * ranges / (1 << 32)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """One row per source: its size and target. ``sizes``: _source, source_size."""
    every = Window.orderBy(F.col("_source").asc_nulls_last())
    nth = F.row_number().over(every)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth - 1) % len(weights) + 1)
    sources = sizes.select(
        "_source", "source_size", weight.alias("w"), nth.alias("nth"),
        (F.lit(float(epochs)) * F.col("source_size")).alias("cap"),
    )
    # By cap per weight: all sources before the first whose fair share is below its cap are full.
    full = Window.orderBy(F.col("cap") / F.col("w"), "nth")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = sources.select(
        "*", F.row_number().over(full).alias("at"),
        ((F.sum("source_size").over(all_rows) * F.lit(float(share))
          - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("level"),
    )
    open_at = F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("at"))
    shared = shared.select(
        "*", F.min_by("level", open_at).over(all_rows).alias("final"),
        F.min(open_at).over(all_rows).alias("open"),
    )
    target = F.when(F.col("at") >= F.col("open"), F.least(F.col("final") * F.col("w"), F.col("cap")))
    return shared.select("_source", "source_size", F.coalesce(target, "cap").alias("target"))


def _plan(
    rows: DataFrame, weights: Sequence[float], share: float, epochs: int
) -> tuple[DataFrame, int]:
    """Per source its size, target, whole epochs, and the range and key at which it is cut.

    ``rows``: a written table of _source, _size and _order.
    """
    ranges = max(1, rows.count() // RANGE_ROWS)
    rows = rows.withColumn("_range", _range(ranges))
    sums = write_out(
        rows.groupBy("_source", "_range").agg(F.sum("_size").alias("n")), "range-sums"
    )
    wanted = targets(
        sums.groupBy("_source").agg(F.sum("n").alias("source_size")), weights, share, epochs
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    wanted = wanted.withColumn("whole", F.coalesce(whole, F.lit(0))).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    wanted = write_out(wanted, "targets")
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    same = sums["_source"].eqNullSafe(wanted["_source"])
    touched = (
        sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(wanted, same).filter("before < rest")
        .groupBy(sums["_source"]).agg(F.max(F.struct("_range", "before", "rest")).alias("cut"))
        .select("_source", F.col("cut._range").alias("_range"), F.col("cut.before").alias("start"),
                F.col("cut.rest").alias("rest"))
    )
    touched = write_out(touched, "cut-ranges")
    inside = (
        rows.alias("r").join(
            touched.alias("t"),
            F.col("r._source").eqNullSafe(F.col("t._source"))
            & (F.col("r._range") == F.col("t._range")),
        )
        .groupBy(F.col("r._source").alias("_source"), "_order", "start", "rest")
        .agg(F.sum("_size").alias("n"))
    )
    running = Window.partitionBy("_source").orderBy("_order").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cuts = (
        inside.withColumn("at", F.col("start") + F.coalesce(F.sum("n").over(running), F.lit(0)))
        .filter(2 * F.col("at") + F.col("n") <= 2 * F.col("rest"))
        .groupBy("_source").agg(F.max("_order").alias("cut_order"))
    )
    plan = (
        wanted.alias("w")
        .join(touched.alias("t"), F.col("w._source").eqNullSafe(F.col("t._source")), "left")
        .join(cuts.alias("c"), F.col("w._source").eqNullSafe(F.col("c._source")), "left")
        .select(F.col("w._source").alias("_of"), "source_size", "target", "whole",
                F.col("t._range").alias("cut_range"), "cut_order")
    )
    return write_out(plan, "cuts"), ranges


def _copies(sized: DataFrame, plan: DataFrame, ranges: int) -> DataFrame:
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    own = _range(ranges)
    more = (own < F.col("cut_range")) | (
        (own == F.col("cut_range")) & (F.col("_order") <= F.col("cut_order"))
    )
    return sized.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).withColumn(
        "_copies", F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")
    )


def shares(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    epochs: int = MAX_EPOCHS, key: str = "doc_id", text: str = "text", source: str = "source",
    seed: int = 1,
) -> DataFrame:
    """Per row: its key, size, source_size, target, copies and the words the mix takes of it."""
    prepare(docs.sparkSession)
    sized = _sized(docs.select(key, text, source), key, text, source, seed)
    sized = write_out(sized.select("key", "_size", "_order", "_source"), "sized")
    plan, ranges = _plan(sized, weights, share, epochs)
    return _copies(sized, plan, ranges).select(
        F.col("key").alias(key), F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    epochs: int = MAX_EPOCHS, key: str = "doc_id", text: str = "text", source: str = "source",
    seed: int = 1,
) -> DataFrame:
    """The mixed rows with all their columns, each as often as the mix takes it."""
    prepare(docs.sparkSession)
    sized = _sized(docs, key, text, source, seed)
    rows = write_out(sized.select("_source", "_size", "_order"), "sizes")
    plan, ranges = _plan(rows, weights, share, epochs)
    return (
        _copies(sized, plan, ranges).filter("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        .select("row.*")
    )
