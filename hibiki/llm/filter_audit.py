"""How filters interact: for every order of them, what each step removes, and what that costs.

Each filter has a table of the ids of the rows that fail it. What a step of an order meets depends
on the set of filters before it only, not on their order. So every row is asked about every such set:

* survivors of a set: rows, left anti the failing ids of the set's filters,
* removed by a filter after a set: the filter's failing ids, left anti those of the set's filters,
* redundant: the same, left semi.

Ids are numbers given to the rows, so that rows with equal or null keys are told apart and none is
hot. One shuffle of a few numbers per row lets all three joins meet; the sets are spread after it,
inside the tasks, and counts per part leave them. Orders are looked up in these counts.

Rows: null texts and null parts are the caller's to fill. A row without a label counts as neither
good nor toxic; several labels of a key count as one that has whatever any of them has. Repeated
rows count as often as they come; equal contents fail the repeat filter where a smaller key has
them, so rows with the smallest key, or with a null key, do not. An empty table has no parts and
gives no rows. Columns are copied under names of the operator's own first, so none can clash.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hibiki.llm.common import prepare
from hibiki.session import write_out

#: Rows of a key and two flags, or of a hash and a key, that may be broadcast (some 40 bytes each).
BROADCAST_ROWS = 500_000


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def failing(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], repeats: str | None,
    key: str, content: str, part: Column, good: str, toxic: str,
) -> tuple[DataFrame, DataFrame]:
    """All rows (row, part), and the id tables: (filter, row, part, good, toxic), one folder a filter.

    ``conditions`` say when a row fails; ``repeats`` names the filter that equal contents fail.
    """
    fails = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), F.isnotnull)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), part.alias("part"),
        fails.alias("fails"), F.unhex(F.md5(F.coalesce(F.col(content), F.lit("")))).alias("same"),
    )
    rows = write_out(rows, "judged")
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.coalesce(F.col(good) == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col(toxic) == 1, F.lit(False))).alias("toxic"),
    )
    marks = write_out(marks.filter("good OR toxic"), "labels")
    ids = rows.filter(F.size("fails") > 0).select("row", "key", "part", F.explode("fails").alias("filter"))
    if repeats is not None:
        again = rows.groupBy("same").agg(F.min("key").alias("least"), F.max("key").alias("most"))
        again = write_out(again.filter("least < most").select("same", "least"), "repeated")
        copies = rows.join(_small(again), "same").filter("key > least")
        ids = ids.unionByName(copies.select("row", "key", "part", F.lit(repeats).alias("filter")))
    told = ids.join(_small(marks), "key", "left").select(
        "row", "part", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "filter",
    )
    return rows.select("row", "part"), write_out(told, "failing", "filter")


def _cells(rows: DataFrame, ids: DataFrame, names: list[str]) -> DataFrame:
    """Counts per part, set of filters before (``taken``, a bit each) and filter (``own``, 0: none)."""
    bits = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(1 << i))])
    ids = ids.select("row", "part", "good", "toxic", F.element_at(bits, F.col("filter")).alias("own"))
    sets = F.array(*[F.lit(s) for s in range(1 << len(names))])
    before = ids.select(F.col("row").alias("of"), F.col("own").alias("by"))
    earlier = (F.col("row") == F.col("of")) & (F.col("taken").bitwiseAND(F.col("by")) != 0)
    # Dealt out by row before the sets are spread, so that these are not shuffled.
    asked = ids.repartition("row").withColumn("taken", F.explode(sets)).filter(
        F.col("taken").bitwiseAND(F.col("own")) == 0
    )
    every = rows.repartition("row").withColumn("taken", F.explode(sets))
    count = lambda condition: F.count(F.when(condition, 1))
    zero = F.lit(0).cast("long")
    group = ("part", "taken", "own")
    survivors = (
        every.join(before, earlier, "left_anti").groupBy("part", "taken").agg(F.count(F.lit(1)).alias("kept"))
        .select("part", "taken", F.lit(0).alias("own"), "kept", zero.alias("removed"),
                zero.alias("good_lost"), zero.alias("toxic_lost"), zero.alias("redundant"))
    )
    removed = (
        asked.join(before, earlier, "left_anti").groupBy(*group)
        .agg(F.count(F.lit(1)).alias("removed"), count(F.col("good")).alias("good_lost"),
             count(F.col("toxic")).alias("toxic_lost"))
        .select(*group, zero.alias("kept"), "removed", "good_lost", "toxic_lost", zero.alias("redundant"))
    )
    redundant = (
        asked.join(before, earlier, "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("redundant"))
        .select(*group, zero.alias("kept"), zero.alias("removed"), zero.alias("good_lost"),
                zero.alias("toxic_lost"), "redundant")
    )
    counts = survivors.unionByName(removed).unionByName(redundant).groupBy(*group)
    return counts.agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "good_lost", "toxic_lost", "redundant")])


def audit(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], repeats: str | None = None,
    key: str = "doc_id", content: str = "text", part: Column | None = None, good: str = "quality",
    toxic: str = "toxic",
) -> DataFrame:
    """One row per part, order of the filters (their names run together) and step.

    ``part``, ``filter_order``, ``step``, ``filter``; ``kept`` after the step; ``removed`` by it, and
    of these ``good_lost`` and ``toxic_lost``; ``redundant``: failing the step's filter, but gone
    before; ``unique_fails``: failing this filter only; ``shapley``: what the filter removes, summed
    over all orders. With n filters there are 2 ** n sets and n! orders, so use a handful.
    """
    prepare(docs.sparkSession)
    names = [*conditions, *([repeats] if repeats is not None else [])]
    rows, ids = failing(docs, labels, conditions, repeats, key, content,
                        F.lit("") if part is None else part, good, toxic)
    cells = write_out(_cells(rows, ids, names), "cells")
    steps = [
        F.array(*[
            F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("filter"), F.lit(1 << names.index(name)).alias("own"),
                     F.lit(sum(1 << names.index(x) for x in order[:i])).alias("taken"))
            for i, name in enumerate(order)
        ])
        for order in permutations(names)
    ]
    orders = F.array(*[
        F.struct(F.lit("".join(order)).alias("filter_order"), own.alias("steps"))
        for order, own in zip(permutations(names), steps)
    ])
    grid = (
        cells.select("part").distinct().select("part", F.explode(orders).alias("o"))
        .select("part", "o.filter_order", F.explode("o.steps").alias("s"))
        .select("part", "filter_order", "s.*", (F.col("s.own") + F.col("s.taken")).alias("after"))
    )
    kept = cells.filter("own = 0").selectExpr("part", "taken AS after", "kept")
    met = cells.drop("kept")
    # After all the others, a filter removes just what fails it alone.
    alone = met.filter(f"own > 0 AND own + taken = {(1 << len(names)) - 1}").selectExpr(
        "part", "own", "removed AS unique_fails"
    )
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    found = (
        grid.join(met, ["part", "taken", "own"], "left").join(kept, ["part", "after"], "left")
        .join(alone, ["part", "own"], "left")
        .select("part", "filter_order", "step", "filter", *map(zero, (
            "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")))
    )
    found = write_out(found, "steps")
    shapley = found.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return found.join(shapley, ["part", "filter"])
