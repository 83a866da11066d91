"""Best rows per key.

``row_number() <= k`` is cut to k rows per key inside every task before the shuffle
(WindowGroupLimit in the plan), so a key that holds a third of all rows sends only k rows per
task to the one task that finishes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows of every key in the given order, numbered from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the newest by the given (descending) order."""
    return best_per_key(df, keys, order, 1, "_newest").drop("_newest")


def cap_rounds(calls: DataFrame, limit: int, request: str, round_: str | None = None,
               order: Sequence[Column] = ()) -> DataFrame:
    """Keep the calls of the first rounds; without a round number, number them by ``order``."""
    if round_ is not None:
        return calls.filter(F.col(round_) <= limit)
    window = Window.partitionBy(request).orderBy(*order)
    return calls.withColumn("round", F.dense_rank().over(window)).filter(F.col("round") <= limit)


def first_messages(turns: DataFrame, key: str, turn: str, text: str) -> DataFrame:
    """The text of the first turn per conversation; combined inside each task first."""
    return turns.groupBy(key).agg(F.min_by(text, turn).alias(text))
