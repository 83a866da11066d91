"""From landed files to clean tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hibiki import schemas
from hibiki.functions.text import silver_text
from hibiki.operators.changes import key_violations
from hibiki.operators.enrich import vehicle_id_list
from hibiki.sources.landing import counted, ingest_report, landed_tables, observed_counts
from hibiki.sources.tables import create_namespace, save_table


def with_silver_text(faq: DataFrame) -> DataFrame:
    return faq.withColumn(
        "text", silver_text(F.col("category"), F.col("question"), F.col("answer"))
    )


def normal_customers(customers: DataFrame) -> DataFrame:
    return customers.withColumn("vehicle_ids", vehicle_id_list(customers))


@dataclass(frozen=True)
class SilverReport:
    files: DataFrame
    counts: DataFrame
    violations: dict[str, DataFrame]


def build_silver(
    spark: SparkSession, folder: str, database: str, root: str | None = None, lines: bool = False
) -> SilverReport:
    """Land, store as bronze, clean into silver, and check the keys.

    Bronze keeps what came; customers, vehicles, faq_silver and service_cases_silver are what
    the other jobs read. With ``root`` the tables' files lie below it.
    """
    def save(df: DataFrame, name: str) -> None:
        save_table(df, f"`{database}`.`{name}`", f"{root}/{name}" if root else None)

    create_namespace(spark, database)
    found = landed_tables(spark, folder, lines)
    seen = {}
    for name, df in found.items():
        rows, seen[name] = counted(df)
        save(rows, f"{name}_bronze")
    bronze = {name: spark.table(f"`{database}`.`{name}_bronze`") for name in found}
    silver = {
        "faq": ("faq_silver", with_silver_text),
        "service_cases": ("service_cases_silver", lambda df: df),
        "customers": ("customers", normal_customers),
        "vehicles": ("vehicles", lambda df: df),
    }
    violations = {}
    for name, (table, clean) in silver.items():
        if name in bronze:
            save(clean(bronze[name]), table)
            stored = spark.table(f"`{database}`.`{table}`")
            violations[table] = key_violations(stored, [schemas.KEYS[name]])
    return SilverReport(
        files=ingest_report(spark, found), counts=observed_counts(spark, seen), violations=violations
    )
