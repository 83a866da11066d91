"""Queries that run as streams over the files of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from hibiki.catalog import sql as S
from hibiki.catalog import views as V
from hibiki.catalog.retrieval import SQL as RETRIEVAL
from hibiki.session import new_path
from hibiki.streaming import jobs as J


def _stream(spark, d, name):
    schema = V.table(spark, d, name).schema
    # A pattern, as a stream takes a single file only when a pattern finds it.
    return J.read_files(spark, f"{d}/{name}.parque[t]", schema)


def stream_index_sync(spark, d):
    passages = _stream(spark, d, "documents").select("doc_id", "text")
    path = new_path(spark, "stream-index")
    index = J.sync_index_from_stream(passages, path, f"{path}-progress", "doc_id")
    return index.vocab.select("token", "df", F.round("idf", 6).alias("idf"))


def stream_enrich(spark, d):
    asked = _stream(spark, d, "events").select(
        "event_id", V.coded("C", F.col("user_id") * 20).alias("customer_id"), "event_type"
    )
    path = new_path(spark, "stream-enriched")
    return J.enrich_stream(asked, V.customers(spark, d), path, f"{path}-progress").select(
        "event_id", "customer_id", "event_type", "name", "tier", "error"
    )


def stream_feedback(spark, d):
    events = _stream(spark, d, "events").select("ts", "event_type")
    kind = F.col("event_type")
    path = new_path(spark, "stream-feedback")
    return J.feedback_per_day(
        events, kind == "purchase", kind == "error", path, f"{path}-progress"
    )


QUERIES = {
    "stream_index_sync": stream_index_sync,
    "stream_enrich": stream_enrich,
    "stream_feedback": stream_feedback,
}

SQL = {
    "stream_index_sync": RETRIEVAL["index_sync"],
    "stream_enrich": S.with_(S.CUST) + """SELECT event_id, e.customer_id, event_type, name, tier,
        CASE WHEN c.customer_id IS NULL
          THEN '顧客ID ''' || e.customer_id || ''' が見つかりません。' END AS error
        FROM (SELECT *, 'C' || lpad((user_id * 20)::VARCHAR, 9, '0') AS customer_id FROM events) e
        LEFT JOIN cust c USING (customer_id)""",
    "stream_feedback": """SELECT strftime(ts, '%Y-%m-%d') AS day,
        count(*) FILTER (event_type = 'purchase') AS up,
        count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY 1""",
}
