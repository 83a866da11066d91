"""Jobs over named tables, as a scheduler would start them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hibiki import constants as C
from hibiki.operators.ranking import latest_per_key
from hibiki.operators.text_index import TextIndex, sync_text_index
from hibiki.operators.tools import ToolData, run_tools
from hibiki.sources.tables import read_table, save_table


def sync_index(
    spark: SparkSession, table: str, path: str, key: str, text: str = "text",
    attributes: Sequence[str] = (),
) -> TextIndex:
    """Create or update the index of a named table."""
    return sync_text_index(read_table(spark, table), path, key, text, attributes)


def run_tool_calls(
    calls: DataFrame, data: ToolData, log_path: str, day: str, max_rounds: int = C.MAX_ROUNDS
) -> DataFrame:
    """Run the calls of a day, store them as the trace log's part for that day and return it.

    A repeated run replaces the day.
    """
    run_tools(calls, data, max_rounds).write.mode("overwrite").parquet(f"{log_path}/day={day}")
    return calls.sparkSession.read.parquet(log_path).filter(F.col("day") == day)


def publish_latest(
    spark: SparkSession, table: str, keys: Sequence[str], version: str, target: str,
    path: str | None = None,
) -> None:
    """Store the newest row of every key, for lookups by key."""
    rows = latest_per_key(read_table(spark, table), keys, [F.desc(version)])
    save_table(rows, target, path)
