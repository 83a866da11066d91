"""Differences between two snapshots of a keyed table, and checks of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_snapshots(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows that lead from one snapshot to the next, as a change feed.

    ``_change_type`` is insert, delete, update_preimage or update_postimage. One shuffle per
    side; equal rows stay silent. Keys must be unique in either snapshot.
    """
    columns = new.columns
    before = old.select(F.col(key).alias("_key"), F.struct(*columns).alias("_old"))
    after = new.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))

    def row(kind: str, image: str):
        return F.struct(F.lit(kind).alias("_change_type"), F.col(image).alias("_row"))

    rows = (
        F.when(F.col("_old").isNull(), F.array(row("insert", "_new")))
        .when(F.col("_new").isNull(), F.array(row("delete", "_old")))
        .otherwise(F.array(row("update_preimage", "_old"), row("update_postimage", "_new")))
    )
    return (
        before.join(after, "_key", "full")
        .filter(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(F.explode(rows).alias("_change"))
        .select("_change._change_type", "_change._row.*")
    )


def apply_diff(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The snapshot after the changes."""
    fresh = changes.filter(F.col("_change_type").isin("insert", "update_postimage"))
    return old.join(changes.select(key), key, "left_anti").unionByName(fresh.drop("_change_type"))


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or occur more than once, with their number of rows."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return (
        df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter((F.col("n_rows") > 1) | missing)
    )
