"""Jobs that pick up what has arrived since their last run.

Each runs once over all new input and stops (``availableNow``); a second run sees only newer
input. Run one again after a failure with the same checkpoint: every batch leaves the same
result when it is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hibiki.operators.enrich import enrich_customers
from hibiki.operators.ranking import latest_per_key
from hibiki.operators.text_index import (
    TextIndex,
    apply_changes,
    head,
    refresh_text_index,
    store_passages,
)


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files that appear below a path."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def sync_index_from_stream(
    passages: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "id",
    text: str = "text",
    attributes: Sequence[str] = (),
    newest: Sequence[Column] = (),
) -> TextIndex:
    """Insert or replace the passages that have arrived, then derive the index's stats once.

    Each batch is a generation of the index; the last one gets its stats also where an earlier run
    failed before it could derive them. Readers keep the generation they opened. ``newest`` orders
    the versions of an id within a batch, newest first; without it an id may come only once per batch.
    """
    spark = passages.sparkSession

    def upsert(batch: DataFrame, batch_id: int) -> None:
        if newest:
            batch = latest_per_key(batch, [key], newest)
        batch = batch.persist()
        if head(spark, path) is not None:
            apply_changes(batch, path, None, key, text, attributes)
        else:
            store_passages(batch, path, key, text, attributes)
        batch.unpersist()

    query = (
        passages.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return refresh_text_index(spark, path)


def enrich_stream(requests: DataFrame, customers: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Add the customer to each request that has arrived; returns the table so far."""
    query = (
        enrich_customers(requests, customers)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return requests.sparkSession.read.parquet(out)


def feedback_per_day(
    feedback: DataFrame, is_up: Column, is_down: Column, out: str, checkpoint: str,
    time: str = "ts",
) -> DataFrame:
    """Thumbs up and down per day: (day, up, down), however late a row arrives.

    Each batch writes its own counts per day under its number, so a repeated batch replaces
    itself, and reading adds them up. No state is kept and no row is too late. Each checkpoint has
    counts of its own: a job that starts over with a new one, or with an emptied one, reads all its
    input again and counts from nothing, whatever an earlier one left in ``out``.
    """
    own = f"{out}/job-{hashlib.md5(checkpoint.encode()).hexdigest()}"
    marked = feedback.select(
        F.date_format(time, "yyyy-MM-dd").alias("day"), is_up.alias("up"), is_down.alias("down")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("day").agg(
            F.count_if("up").alias("up"), F.count_if("down").alias("down")
        )
        if batch_id == 0:
            # The first batch of all: what lies there is from a checkpoint that is gone.
            counts.withColumn("batch", F.lit(0)).write.mode("overwrite").option(
                "partitionOverwriteMode", "static"
            ).partitionBy("batch").parquet(own)
        else:
            counts.write.mode("overwrite").parquet(f"{own}/batch={batch_id}")

    query = (
        marked.writeStream.outputMode("append")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    lines = feedback.sparkSession.read.schema("day string, up long, down long").parquet(own)
    return lines.groupBy("day").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
