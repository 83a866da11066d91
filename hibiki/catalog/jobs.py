"""Queries that run whole jobs: landing and loading, traces, the online copy, answers, a day."""

from __future__ import annotations

from pyspark.sql import functions as F

from hibiki import constants as C
from hibiki.catalog import evaluation as EV
from hibiki.catalog import sql as S
from hibiki.catalog import views as V
from hibiki.catalog.service import tool_data
from hibiki.functions import vehicles as VE
from hibiki.operators.answers import answer_ledger
from hibiki.operators.evaluation import metric_summary
from hibiki.operators.spans import request_spans
from hibiki.plans.daily import read_days, run_day
from hibiki.plans.evaluate import RULES
from hibiki.plans.online import read_online, sync_online
from hibiki.plans.silver import build_silver
from hibiki.session import new_path
from hibiki.sources.json_arrays import read_json_array, write_json_array
from hibiki.sources.landing import schema_drift
from hibiki.sources.tables import append_rows, create_namespace, read_table, save_table

GAP = 8 * 3600
DAY = "1998-06-30"


def _land(spark, d) -> str:
    """Three of the expected files, made of the given tables."""
    folder = new_path(spark, "landed")
    V.kb(spark, d).select(
        F.col("id").cast("string").alias("id"), "category", "question", "answer", "applicable_tier"
    ).write.json(f"{folder}/{C.LANDING_FILES['faq']}")
    V.customers(spark, d).write.json(f"{folder}/{C.LANDING_FILES['customers']}")
    V.vehicles(spark, d).write.json(f"{folder}/{C.LANDING_FILES['vehicles']}")
    return folder


def _silver(spark, d):
    folder = _land(spark, d)
    name = "silver_" + folder[-12:]
    return name, build_silver(spark, folder, name, f"{folder}-tables", lines=True)


def build_silver_(spark, d):
    name, _ = _silver(spark, d)
    return read_table(spark, f"{name}.faq_silver").select("id", "text", "applicable_tier")


def landing_report(spark, d):
    """Which expected files came, how many rows they held, and how many of them break the key."""
    _, report = _silver(spark, d)
    broken = None
    for table, rows in report.violations.items():
        one = rows.agg(F.count(F.lit(1)).alias("broken_keys")).select(
            F.lit(table.removesuffix("_silver")).alias("table"), "broken_keys"
        )
        broken = one if broken is None else broken.unionByName(one)
    return report.files.join(report.counts, "table", "left").join(broken, "table", "left").select(
        "table", "status", "n_rows", "broken_keys"
    )


def json_array_read(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text", "lang")
    folder = new_path(spark, "arrays")
    write_json_array(docs, folder)
    return read_json_array(spark, folder, docs.schema)


def schema_drift_(spark, d):
    events = V.table(spark, d, "events").withColumn(
        "row", F.to_json(F.struct("event_id", "event_type", F.col("props").alias("extra")))
    )
    declared = events.select("event_id", "event_type").schema
    return schema_drift(events, "row", declared)


def save_and_read(spark, d):
    name = "saved_" + new_path(spark, "x")[-12:]
    create_namespace(spark, name)
    save_table(V.vehicles(spark, d), f"{name}.vehicles", new_path(spark, "vehicles"))
    return read_table(spark, f"{name}.vehicles")


def append_days(spark, d):
    events = V.table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    path = new_path(spark, "appended")
    for kind in ("purchase", "error"):
        append_rows(events.filter(F.col("event_type") == kind), path, ["day"])
    stored = spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "event_type")
    return stored.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n_rows"))


def recall_flags(spark, d):
    status = (
        F.when(F.col("model") == "1-URGENT", "対象あり").when(F.col("model") == "2-HIGH", "対象あり(改修済み)")
        .when(F.col("model") == "3-MEDIUM", "対象なし")
    )
    owned = V.vehicles(spark, d).withColumn("status", status)
    return owned.select(
        "vehicle_id", VE.recall_affected(F.col("status")).alias("affected"),
        VE.recall_repaired(F.col("status")).alias("repaired"),
    )


def cost_amounts(spark, d):
    n = F.col("n_chars")
    text = (
        F.when(n % 4 == 0, F.format_string("%d円〜%d円", n, n + 500))
        .when(n % 4 == 1, F.format_string("部品 %d円 + 工賃 200円 = %d円。", n, n + 200))
        .when(n % 4 == 2, "無償で対応")
    )
    docs = V.table(spark, d, "documents").withColumn("cost", text)
    return docs.select(
        "doc_id", VE.cost_low(F.col("cost")).alias("low"), VE.cost_high(F.col("cost")).alias("high"),
        VE.cost_free(F.col("cost")).alias("free"),
    )


def metric_scores(spark, d):
    tiers = V.customers(spark, d).select("customer_id", "tier")
    scored = RULES.score(V.pairs(spark, d).join(tiers, "customer_id", "left"))
    return scored.select("request_id", *[m.score_column for m in RULES])


def trace_spans(spark, d):
    events = V.table(spark, d, "events")
    return request_spans(events, GAP, "user_id", "event_id", "event_type")


def online_sync(spark, d):
    """Three feeds of changes, one of them twice, and one that removes keys."""
    events = V.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    path = new_path(spark, "online")
    for part in (1, 0, 1, 2):
        changes = events.filter(F.col("event_id") % 3 == part)
        sync_online(changes, path, ["user_id"], "event_id", F.col("event_type") == "error")
    return read_online(spark, path)


def read_aloud(text: str) -> str:
    """An answer function for tests: it fails on requests in which it finds water."""
    if "eau" in text:
        raise ValueError("cannot read this")
    return f"{len(text)}: {text}"


def answer_ledger_(spark, d):
    asked = V.requests(spark, d).select("request_id", F.col("text").alias("request"))
    path = new_path(spark, "ledger")
    answer_ledger(asked.filter("request_id % 2 = 0"), read_aloud, path, workers=C.ANSWER_WORKERS)
    return answer_ledger(asked, read_aloud, path, workers=C.ANSWER_WORKERS)


def _day(spark, d):
    """The folder of a day's tables; the day is run once per session and table folder."""
    def run(root: str) -> None:
        docs = V.table(spark, d, "documents").select(
            F.col("doc_id").alias("request_id"), F.col("text").alias("expected_response"),
            F.col("text").alias("ground_truth_context"),
        )
        run_day(V.requests(spark, d), tool_data(spark, d), V.links(spark, d), V.PROMPT, root, DAY,
                V.calls(spark, d), docs)

    return V.kept(spark, d, "day", run)


def daily_scores(spark, d):
    scores = read_days(spark, _day(spark, d), "scores")
    return metric_summary(scores).select("metric", F.round("mean_score", 4).alias("mean_score"), "n_scores")


def daily_answers(spark, d):
    return read_days(spark, _day(spark, d), "answers").select("request_id", "customer_id", "tier", "question", "response")


def daily_bookings(spark, d):
    stored = read_days(spark, _day(spark, d), "bookings")
    return stored.select(F.col("day").cast("string").alias("day"), "call_id", "booking_id", "vehicle_id")


QUERIES = {
    "build_silver": build_silver_,
    "landing_report": landing_report,
    "json_array_read": json_array_read,
    "schema_drift": schema_drift_,
    "save_and_read": save_and_read,
    "append_days": append_days,
    "recall_flags": recall_flags,
    "cost_amounts": cost_amounts,
    "metric_scores": metric_scores,
    "trace_spans": trace_spans,
    "online_sync": online_sync,
    "answer_ledger": answer_ledger_,
    "daily_scores": daily_scores,
    "daily_answers": daily_answers,
    "daily_bookings": daily_bookings,
}

_D = S.corpus("d", "documents", "doc_id")
_ANSWERS = [
    S.CUST, S.REQ, S.KB, """asked AS (SELECT request_id, customer_id, coalesce(tier, 'standard') AS customer_tier, text
  FROM req LEFT JOIN cust USING (customer_id))""", _D, S.ranked("s", "d", "asked", "request_id"),
    """t AS (SELECT q, s.id, score, customer_tier, applicable_tier, answer FROM s JOIN asked ON request_id = q
  JOIN kb USING (id))""", S.best("c", "t", 6), f"k AS (SELECT * EXCLUDE (rank) FROM c WHERE {S.ALLOWS})",
    S.best("b", "k", 1), f"""pairs AS (SELECT request_id, asked.customer_id, asked.customer_tier AS tier, asked.text AS question,
  coalesce(nullif(answer, ''), '{C.ANSWER_FALLBACK}') AS response, coalesce(d.text, '') AS expected_response,
  coalesce(d.text, '') AS ground_truth_context
  FROM asked LEFT JOIN b ON q = request_id LEFT JOIN documents d ON d.doc_id = request_id)""",
]

SQL = {
    "build_silver": S.with_(S.KB) + """SELECT id::VARCHAR AS id, 'カテゴリ: ' || category || chr(10) || '質問: ' || question
        || chr(10) || '回答: ' || answer AS text, applicable_tier FROM kb""",
    "landing_report": """SELECT 'faq' AS "table", 'copied' AS status, count(*) AS n_rows,
          count(*) - count(DISTINCT doc_id) AS broken_keys FROM documents
        UNION ALL SELECT 'customers', 'copied', count(*), count(*) - count(DISTINCT c_custkey) FROM customer
        UNION ALL SELECT 'vehicles', 'copied', count(*), count(*) - count(DISTINCT o_orderkey) FROM orders
        UNION ALL SELECT unnest(['service_cases', 'eval_dataset']), 'missing', NULL, NULL""",
    "json_array_read": "SELECT doc_id, text, lang FROM documents",
    "schema_drift": "SELECT 'extra' AS field, count(props) AS n_rows FROM events",
    "save_and_read": S.with_(S.VEH) + "SELECT * FROM veh",
    "append_days": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_rows FROM events
        WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2""",
    "recall_flags": S.with_(S.VEH) + """SELECT vehicle_id,
        CASE model WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN true WHEN '3-MEDIUM' THEN false END AS affected,
        CASE model WHEN '1-URGENT' THEN false WHEN '2-HIGH' THEN true WHEN '3-MEDIUM' THEN false END AS repaired FROM veh""",
    "cost_amounts": """SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars + 200 END AS low,
        CASE n_chars % 4 WHEN 0 THEN n_chars + 500 WHEN 1 THEN n_chars + 200 END AS high,
        CASE n_chars % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true END AS free FROM documents""",
    "metric_scores": S.with_(S.CUST, S.PAIRS) + f"""SELECT request_id, ({EV._TIER})::DOUBLE AS "tier_percentages/score",
        ({EV._safety({"safety": C.SAFETY_WORDS, "defer": C.DEFER_WORDS, "urgent": C.URGENT_WORDS, "action": C.ACTION_WORDS})})::DOUBLE
          AS "safety_words/score" FROM (SELECT *, {EV._PERCENT.format(c='response')} AS p
          FROM pairs LEFT JOIN cust USING (customer_id))""",
    "trace_spans": f"""WITH stepped AS (SELECT *, lag(ts) OVER own AS before FROM events WINDOW own AS
  (PARTITION BY user_id ORDER BY ts, event_id)),
opened AS (SELECT *, max(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > {GAP * 1_000_000} THEN ts END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS began FROM stepped),
timed AS (SELECT user_id || '-' || strftime(began, '%Y%m%d%H%M%S') AS trace_id, *, coalesce(epoch_us(lead(ts) OVER
  (PARTITION BY user_id, began ORDER BY ts, event_id)) - epoch_us(ts), 0) AS micros FROM opened)
SELECT trace_id, event_id::VARCHAR AS span_id, trace_id AS parent_id, event_type AS name, 'tool' AS span_type,
  ts AS started, micros FROM timed
UNION ALL SELECT trace_id, trace_id, NULL, 'request', 'chain', began, sum(micros)::BIGINT FROM timed GROUP BY trace_id, began""",
    "online_sync": """SELECT * FROM (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
        arg_max(value, event_id) AS value FROM events GROUP BY user_id) WHERE event_type <> 'error'""",
    "answer_ledger": S.with_(S.REQ) + """SELECT request_id, text AS request, CASE WHEN contains(text, 'eau')
        THEN 'エラー: cannot read this' ELSE length(text) || ': ' || text END AS response FROM req""",
    "daily_scores": S.with_(*_ANSWERS, EV._TOKENS, EV._F1, EV._REL, EV._SUP, f"""m AS (SELECT request_id, ({EV._TIER})::DOUBLE
      AS tier_percentages, ({EV._safety({"safety": C.SAFETY_WORDS, "defer": C.DEFER_WORDS, "urgent": C.URGENT_WORDS,
                                         "action": C.ACTION_WORDS})})::DOUBLE AS safety_words,
      1.0 + 4 * (regexp_extract_all(lower(response), '{S.WORD}') = regexp_extract_all(lower(expected_response), '{S.WORD}'))::INTEGER
        AS exact_match FROM (SELECT *, {EV._PERCENT.format(c='response')} AS p FROM pairs))""",
        EV._LONG) + """SELECT metric, round(avg(score), 4) AS mean_score, count(score) AS n_scores FROM long GROUP BY 1""",
    "daily_bookings": S.with_(S.CALLS) + f"SELECT '{DAY}' AS day, call_id, booking_id, vehicle_id FROM booked",
    "daily_answers": S.with_(*_ANSWERS) + "SELECT request_id, customer_id, tier, question, response FROM pairs",
}
