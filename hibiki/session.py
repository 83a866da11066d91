"""Session settings and the shared folder for tables written between the steps of a job."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key is split at run time, even where that costs another shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Tables in buckets by one of several join keys are joined where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings this package relies on; sizes stay the cluster's choice."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/hibiki-steps"


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written yet, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write a table that several later steps read, and return it read back.

    The files survive the loss of an executor, and later plans start from them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def bucket_table(
    spark: SparkSession, path: str, columns: str, by: str, buckets: int, sort: str
) -> str:
    """The name of a bucketed table over a folder, made where the catalogue does not know it yet.

    Joins and sums by the bucket column start from its files without a shuffle. Rows are added by
    ``insertInto``; deal them by the column into as many partitions first.
    """
    name = "bucketed_" + hashlib.md5(path.encode()).hexdigest()
    if spark.catalog.tableExists(name):
        # Another session, such as a stream's, may have added files.
        spark.catalog.refreshTable(name)
    else:
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({sort}) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return name


def broadcast_if(df: DataFrame, row_bytes, limit: int) -> DataFrame:
    """The table, to be broadcast if all its rows together have at most so many bytes.

    ``row_bytes``: a number, or a column that tells a row's size.
    """
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.sum(size.cast("long")).alias("bytes")).first().bytes
    return F.broadcast(df) if (total or 0) <= limit else df


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most so many rows, and may be broadcast."""
    return df.count() <= rows
