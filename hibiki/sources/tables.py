"""Named tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def create_namespace(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace a table with the rows given."""
    writer = df.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def append_rows(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Add rows to a growing table such as bookings, answers or scores."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def preview(df: DataFrame, columns: Sequence[str], order: Sequence[Column], n: int = 2) -> DataFrame:
    """A few rows to look at, always the same ones."""
    return df.select(*columns).orderBy(*order).limit(n)
