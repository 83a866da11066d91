"""Queries over sources, tables and single columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hibiki import constants as C
from hibiki.catalog import sql as S
from hibiki.catalog import views as V
from hibiki.functions import scores as SC
from hibiki.functions import text as TX
from hibiki.functions.tiers import tier_allows
from hibiki.operators.changes import diff_snapshots, key_violations
from hibiki.operators.enrich import lookup
from hibiki.operators.ranking import first_messages, latest_per_key
from hibiki.plans.silver import with_silver_text
from hibiki.sources.landing import row_counts
from hibiki.sources.tables import preview


def scan_table(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "customer")


def ingest_counts(spark, d):
    return row_counts({name: V.table(spark, d, name) for name in V.TABLES})


def key_violations_(spark, d):
    return key_violations(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def preview_rows(spark, d):
    return preview(V.kb(spark, d), ["id", "category", "question"], [F.asc("id")])


def change_feed(spark, d):
    part = V.table(spark, d, "part")
    old = part.filter("p_brand <> 'Brand#9'")
    price = F.when(F.col("p_brand") == "Brand#1", F.col("p_retailprice") + 10).otherwise(
        F.col("p_retailprice")
    )
    new = part.filter("p_brand <> 'Brand#25'").withColumn("p_retailprice", price)
    return diff_snapshots(old, new, "p_partkey")


def silver_text(spark, d):
    faq = V.kb(spark, d).withColumn("category", F.when(F.col("question") != "es", F.col("category")))
    return with_silver_text(faq).select("id", "text")


def project_cols(spark, d):
    return V.kb(spark, d).select("id", "category", "question", "applicable_tier")


def point_lookup(spark, d):
    asked = V.table(spark, d, "events").select(
        "event_id", V.coded("C", F.col("user_id")).alias("customer_id")
    )
    return asked.join(V.customers(spark, d), "customer_id").select(
        "event_id", "customer_id", "name", "tier"
    )


def tier_filter(spark, d):
    tier = (
        F.when(F.col("question") == "en", "gold").when(F.col("question") == "fr", "silver")
        .when(F.col("question") == "de", "")
    )
    asked = V.kb(spark, d).withColumn("customer_tier", tier)
    return asked.filter(tier_allows(F.col("applicable_tier"), F.col("customer_tier"))).select(
        "id", "applicable_tier", "customer_tier"
    )


def lookup_or_error(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    asked = V.table(spark, d, "events").filter("event_type = 'view'").select(
        "event_id", V.coded("V", F.col("user_id") * 101 + k).alias("vehicle_id")
    )
    found = lookup(asked, V.vehicles(spark, d), "vehicle_id", C.VEHICLE_NOT_FOUND)
    return found.select("event_id", "vehicle_id", "owner_id", "model", "error")


def default_fill(spark, d):
    labels = V.table(spark, d, "labels").select("doc_id", F.col("quality").cast("string"))
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", TX.or_empty(F.col("quality")).alias("quality")
    )


def final_answer(spark, d):
    content = F.when(F.col("turn") == 1, "").when(F.col("role") != "system", F.col("text"))
    return V.table(spark, d, "conversations").select(
        "conv_id", "turn", TX.final_answer(content).alias("content")
    )


def latest_per_key_(spark, d):
    events = V.table(spark, d, "events")
    return latest_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select(
        "user_id", "event_id", "event_type", "value"
    )


def first_message(spark, d):
    return first_messages(V.table(spark, d, "conversations"), "conv_id", "turn", "text")


def json_array(spark, d):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    text = F.when(segment == "MACHINERY", F.concat(F.lit('["'), name)).otherwise(
        F.concat(F.lit('["'), name, F.lit('", "'), segment, F.lit('"]'))
    )
    parsed = TX.json_list(text)
    return V.table(spark, d, "customer").select(
        "c_custkey", F.array_join(parsed, "|").alias("ids"),
        F.when(parsed.isNotNull(), F.size(parsed)).alias("n_ids"),
    )


def json_rows(spark, d):
    columns = ["id", "category", "question", "answer", "applicable_tier"]
    kb = V.kb(spark, d).withColumn("question", F.nullif(F.col("question"), F.lit("es")))
    return kb.select("id", TX.as_json(*map(F.col, columns)).alias("json"))


def shortened(spark, d):
    return V.kb(spark, d).select("id", TX.shorten(F.col("text"), 60).alias("short"))


def extract_ids(spark, d):
    asked = V.requests(spark, d).withColumn(
        "text",
        F.when(F.col("request_id") % 3 == 0, F.col("text")).otherwise(
            F.concat(F.lit("顧客ID "), F.col("customer_id"), F.lit("です。V0123も。"), F.col("text"))
        ),
    )
    return asked.select(
        "request_id", TX.first_id(F.col("text"), "C").alias("customer_id"),
        TX.first_id(F.col("text"), "V").alias("vehicle_id"),
    )


def parse_dates(spark, d):
    day = F.when(F.col("model") == "5-LOW", F.concat(F.col("purchase_date"), F.lit("x"))).otherwise(
        F.col("purchase_date")
    )
    return V.vehicles(spark, d).select(
        "vehicle_id", F.date_format(TX.slash_date(day), "yyyy-MM-dd").alias("purchase_day")
    )


def score_bar(spark, d):
    value = F.col("l_discount") * 60 - 0.5
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", SC.score_bar(value).alias("bar")
    )


QUERIES = {
    "scan_table": scan_table,
    "ingest_counts": ingest_counts,
    "key_violations": key_violations_,
    "preview_rows": preview_rows,
    "change_feed": change_feed,
    "silver_text": silver_text,
    "project_cols": project_cols,
    "point_lookup": point_lookup,
    "tier_filter": tier_filter,
    "lookup_or_error": lookup_or_error,
    "default_fill": default_fill,
    "final_answer": final_answer,
    "latest_per_key": latest_per_key_,
    "first_message": first_message,
    "json_array": json_array,
    "json_rows": json_rows,
    "shortened": shortened,
    "extract_ids": extract_ids,
    "parse_dates": parse_dates,
    "score_bar": score_bar,
}

SQL = {
    "scan_table": "SELECT * FROM customer",
    "ingest_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in V.TABLES
    ),
    "key_violations": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
        GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
    "preview_rows": S.with_(S.KB) + "SELECT id, category, question FROM kb ORDER BY id LIMIT 2",
    "change_feed": """WITH o AS (SELECT * FROM part WHERE p_brand <> 'Brand#9'),
        n AS (SELECT * REPLACE (CASE WHEN p_brand = 'Brand#1' THEN p_retailprice + 10
          ELSE p_retailprice END AS p_retailprice) FROM part WHERE p_brand <> 'Brand#25')
        SELECT 'delete' AS _change_type, * FROM o
          WHERE p_partkey NOT IN (SELECT p_partkey FROM n)
        UNION ALL SELECT 'insert', * FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM o)
        UNION ALL SELECT 'update_preimage', o.* FROM o JOIN n USING (p_partkey) WHERE o <> n
        UNION ALL SELECT 'update_postimage', n.* FROM o JOIN n USING (p_partkey) WHERE o <> n""",
    "silver_text": S.with_(S.KB) + """SELECT id, concat_ws(chr(10),
        'カテゴリ: ' || CASE WHEN question <> 'es' THEN category END,
        '質問: ' || question, '回答: ' || answer) AS text FROM kb""",
    "project_cols": S.with_(S.KB) + "SELECT id, category, question, applicable_tier FROM kb",
    "point_lookup": S.with_(S.CUST) + """SELECT event_id, customer_id, name, tier FROM events
        JOIN cust ON customer_id = 'C' || lpad(user_id::VARCHAR, 9, '0')""",
    "tier_filter": S.with_(S.KB) + f"""SELECT * FROM (SELECT id, applicable_tier,
        CASE question WHEN 'en' THEN 'gold' WHEN 'fr' THEN 'silver' WHEN 'de' THEN '' END
        AS customer_tier FROM kb) WHERE {S.ALLOWS}""",
    "lookup_or_error": S.with_(S.VEH) + """SELECT event_id, a.vehicle_id, owner_id, model,
        CASE WHEN v.vehicle_id IS NULL THEN '車両ID ''' || a.vehicle_id || ''' が見つかりません。' END
        AS error FROM (SELECT event_id, 'V' || lpad((user_id * 101
          + json_extract(props, '$.k')::BIGINT)::VARCHAR, 9, '0') AS vehicle_id
          FROM events WHERE event_type = 'view') a LEFT JOIN veh v USING (vehicle_id)""",
    "default_fill": """SELECT doc_id, text, coalesce(quality::VARCHAR, '') AS quality
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "final_answer": """SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn = 1 THEN ''
        WHEN role <> 'system' THEN text END, ''), '申し訳ありません。回答を生成できませんでした。')
        AS content FROM conversations""",
    "latest_per_key": """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number()
        OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "first_message": "SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1",
    "json_array": """SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY'
        THEN c_name || '|' || c_mktsegment END AS ids,
        CASE WHEN c_mktsegment <> 'MACHINERY' THEN 2 END AS n_ids FROM customer""",
    "json_rows": S.with_(S.KB) + """SELECT id, to_json({'id': id, 'category': category,
        'question': nullif(question, 'es'), 'answer': answer,
        'applicable_tier': applicable_tier})::VARCHAR AS json FROM kb""",
    "shortened": "SELECT doc_id AS id, left(text, 60) || '...' AS short FROM documents",
    "extract_ids": S.with_(S.REQ) + """SELECT request_id,
        CASE WHEN request_id % 3 <> 0 THEN customer_id END AS customer_id,
        CASE WHEN request_id % 3 <> 0 THEN 'V0123' END AS vehicle_id FROM req""",
    "parse_dates": S.with_(S.VEH) + """SELECT vehicle_id, CASE WHEN model <> '5-LOW'
        THEN strftime(strptime(purchase_date, '%Y/%m/%d'), '%Y-%m-%d') END AS purchase_day
        FROM veh""",
    "score_bar": """SELECT l_orderkey, l_linenumber, repeat('█', trunc(v)::INTEGER)
        || repeat('░', 5 - trunc(least(v, 5.0))::INTEGER) AS bar
        FROM (SELECT *, l_discount * 60 - 0.5 AS v FROM lineitem)""",
}
