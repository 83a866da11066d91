"""Landed JSON files: which arrived, and reading them with declared schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki import constants as C
from hibiki import schemas


def read_landed(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """One JSON array document per file, or one object per line.

    A document is parsed by one task; ``json_arrays.read_json_array`` reads large ones by many.
    """
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def landed_tables(spark: SparkSession, folder: str, lines: bool = False) -> dict[str, DataFrame]:
    """The expected tables whose file (or folder of files) has arrived."""
    found = {}
    for name, filename in C.LANDING_FILES.items():
        try:
            found[name] = read_landed(spark, f"{folder}/{filename}", schemas.LANDED[name], lines)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def ingest_report(spark: SparkSession, found: dict[str, DataFrame]) -> DataFrame:
    """(table, file, status): ``copied`` or ``missing`` for every expected table."""
    rows = [
        (name, filename, "copied" if name in found else "missing")
        for name, filename in C.LANDING_FILES.items()
    ]
    return spark.createDataFrame(rows, "table string, file string, status string")


def schema_drift(df_json: DataFrame, column: str, declared: T.StructType) -> DataFrame:
    """Fields the declared schema does not have, in a column of JSON objects: (field, n_rows)."""
    return (
        df_json.select(F.explode(F.json_object_keys(column)).alias("field"))
        .filter(~F.col("field").isin(declared.fieldNames()))
        .groupBy("field")
        .agg(F.count("*").alias("n_rows"))
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows) of every table, in one job."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and what tells their number once they have been written: no scan of its own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


def observed_counts(spark: SparkSession, seen: dict[str, Observation]) -> DataFrame:
    """(table, n_rows) of every table that was written with its rows counted."""
    rows = [(name, one.get["n_rows"]) for name, one in seen.items()]
    return spark.createDataFrame(rows, "table string, n_rows long")
