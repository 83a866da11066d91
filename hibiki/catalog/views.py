"""The driver's tables in the shape of the service's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hibiki import constants as C
from hibiki.operators.text_index import TextIndex, build_text_index, open_text_index
from hibiki.operators.vector_table import VectorTable, open_vectors, store_text_vectors
from hibiki.session import configure, new_path

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
PROMPT = "Answer politely and only from the records below."
AS_OF = "1998-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coded(letter: str, number) -> F.Column:
    """Ids such as C000000012."""
    return F.concat(F.lit(letter), F.lpad(number.cast("string"), 9, "0"))


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages, with the tier they are for derived from the id."""
    five = F.col("doc_id") % 5
    tier = (
        F.when(five == 0, "gold").when(five == 1, "silver").when(five == 2, "standard")
        .otherwise("all")
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"),
        F.col("lang").alias("question"), F.col("text").alias("answer"), "text",
        tier.alias("applicable_tier"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service cases, about two models each or about all."""
    five, names = F.col("doc_id") % 5, [
        "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW",
    ]
    first, second = F.lit(names[4]), F.lit(names[0])
    for i, name in enumerate(names[:4]):
        first = F.when(five == i, name).otherwise(first)
        second = F.when(five == i, names[i + 1]).otherwise(second)
    models = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(C.ALL_MODELS))).otherwise(
        F.array(first, second)
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("case_id"), F.col("source").alias("title"),
        F.col("lang").alias("symptoms"), F.col("text").alias("solution"),
        F.concat(F.col("n_chars").cast("string"), F.lit("円")).alias("cost_estimate"),
        F.nullif(F.col("lang"), F.lit("en")).alias("resolution_time"), "text",
        models.alias("applicable_models"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        coded("C", F.col("c_custkey")).alias("customer_id"), F.col("c_name").alias("name"),
        F.when(balance >= 6000, "gold").when(balance >= 2000, "silver").otherwise("standard")
        .alias("tier"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        coded("V", F.col("o_orderkey")).alias("vehicle_id"),
        coded("C", F.col("o_custkey")).alias("owner_id"),
        F.col("o_orderpriority").alias("model"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("purchase_date"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicles customers list: those whose order is not pending."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(
        coded("C", F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderkey").alias("position"),
        coded("V", F.col("o_orderkey")).alias("vehicle_id"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user message of every conversation, asked by the customer of that number."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select(
        F.col("conv_id").alias("request_id"), coded("C", F.col("conv_id")).alias("customer_id"),
        "text",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the assistant turn that follows it.

    Expected is the conversation's last assistant turn, context the document of its number.
    Turns are numbered, so neighbours meet in an equi join and no conversation has to be
    gathered, however long it is.
    """
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    reply = turns.filter("role = 'assistant'")
    after = reply.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    last = reply.groupBy("conv_id").agg(F.max_by("text", "turn").alias("expected_response"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), F.col("text").alias("ground_truth_context")
    )
    return (
        user.join(after, ["conv_id", "turn"])
        .join(last, "conv_id")
        .join(docs, "conv_id", "left")
        .select(
            F.concat_ws("-", "conv_id", "turn").alias("request_id"),
            coded("C", F.col("conv_id")).alias("customer_id"),
            "question", "response", "expected_response",
            F.coalesce("ground_truth_context", F.lit("")).alias("ground_truth_context"),
        )
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide scores per document; relevance is missing for toxic ones, and 3.5 for some."""
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        (1.0 + 4 * F.col("quality")).alias("quality/score"),
        (5.0 - 4 * F.col("toxic")).alias("safety/score"),
        F.when(F.col("toxic") == 0, 1.0 + 2.5 * F.col("quality")).alias("relevance/score"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls: what an event does decides the tool, its numbers the arguments."""
    k, kind = F.col("k"), F.col("event_type")
    events = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    )
    texts = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("asked"), F.col("text").alias("query")
    )
    customer = coded("C", k * 20)
    vehicle = coded("V", F.col("user_id") * 101 + k)
    tier = (
        F.when(F.col("value") < 5, "gold").when(F.col("value") < 10, "silver")
        .when(F.col("value") < 30, "standard").otherwise("platinum")
    )
    name = (
        F.when(kind == "click", "get_customer_info")
        .when(kind == "view", "get_vehicle_info")
        .when(kind == "purchase", "book_service_appointment")
        .when((kind == "signup") & (k < 50), "search_faq")
        .when(kind == "signup", "search_service_cases")
        .otherwise("no_such_tool")
    )
    arguments = (
        F.when(kind == "click", F.to_json(F.struct(customer.alias("customer_id"))))
        .when(kind == "view", F.to_json(F.struct(vehicle.alias("vehicle_id"))))
        .when(kind == "purchase", F.to_json(F.struct(
            customer.alias("customer_id"), vehicle.alias("vehicle_id"),
            F.lit("inspection").alias("service_type"),
            F.when(F.col("value") >= 2, "2024/05/01").alias("preferred_date"),
        )))
        .when((kind == "signup") & (k < 50), F.to_json(F.struct(
            "query", tier.alias("customer_tier"), F.when(k < 10, 2).alias("num_results"),
        )))
        .when((kind == "signup") & (k < 55), F.to_json(F.struct(
            "query", F.lit("2").alias("num_results"),  # a text where a number belongs
        )))
        .when(kind == "signup", F.to_json(F.struct("query")))
        .otherwise("{}")
    )
    return (
        # Calls that ask nothing get keys of their own, so that they do not meet in one task.
        events.withColumn(
            "asked", F.when(kind == "signup", k % 50).otherwise(-1 - F.col("event_id"))
        )
        .join(texts, "asked", "left")
        .select(
            F.col("user_id").alias("request_id"),
            (F.floor(k / 15) + 1).cast("int").alias("round"),
            F.col("event_id").alias("call_id"), name.alias("name"),
            arguments.alias("arguments"),
        )
    )


_indexes: dict[tuple, str] = {}


def kb_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The passages' index, built once per session and table folder."""
    return _index(spark, sf_dir, "kb", lambda: kb(spark, sf_dir), "id", ["applicable_tier"])


def case_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return _index(spark, sf_dir, "cases", lambda: cases(spark, sf_dir), "case_id", [])


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """The path that ``make`` was given to write to, once per session and table folder."""
    configure(spark)
    known = (spark.sparkContext.applicationId, sf_dir, name)
    if known not in _indexes:
        path = new_path(spark, name)
        make(path)
        _indexes[known] = path
    return _indexes[known]


def kb_vectors(spark: SparkSession, sf_dir: str) -> VectorTable:
    """The passages' vectors with their model, stored once per session and table folder."""
    path = kept(spark, sf_dir, "kb-vectors", lambda path: store_text_vectors(
        kb(spark, sf_dir), path, "id", "text", ["applicable_tier"]
    ))
    return open_vectors(spark, path, ["applicable_tier"], texts=True)


def _index(spark, sf_dir, name, docs, key, attributes) -> TextIndex:
    path = kept(spark, sf_dir, name, lambda path: build_text_index(docs(), path, key, "text", attributes))
    return open_text_index(spark, path)


def forget_indexes() -> None:
    """Let the next query build its index again."""
    _indexes.clear()
