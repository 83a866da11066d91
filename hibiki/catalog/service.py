"""Queries over customers, vehicles, tiers, tool calls and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hibiki import constants as C
from hibiki.catalog import sql as S
from hibiki.catalog import views as V
from hibiki.functions import tiers as TR
from hibiki.functions.text import slash_date
from hibiki.functions.vehicles import warranty_state
from hibiki.operators import enrich as E
from hibiki.operators import tools as T
from hibiki.operators.conversation import assemble_messages, feedback_counts
from hibiki.operators.ranking import cap_rounds
from hibiki.operators.text_search import text_topk
from hibiki.plans.context import build_context


def tool_data(spark, d):
    return T.ToolData(
        customers=V.customers(spark, d), vehicles=V.vehicles(spark, d),
        faq=V.kb(spark, d), faq_index=V.kb_index(spark, d),
        cases=V.cases(spark, d), case_index=V.case_index(spark, d),
    )


def enrich_customer(spark, d):
    return E.enrich_customers(V.requests(spark, d), V.customers(spark, d)).select(
        "request_id", "customer_id", "name", "tier", "text", "error"
    )


def enrich_vehicles(spark, d):
    asked = V.requests(spark, d).select("request_id", "customer_id")
    return E.enrich_vehicles(asked, V.links(spark, d), V.vehicles(spark, d)).select(
        "request_id", "customer_id", "vehicle_id", "model", "purchase_date"
    )


def tier_benefits(spark, d):
    return TR.with_benefits(V.customers(spark, d)).select(
        "customer_id", *C.TIER_BENEFIT_COLUMNS
    )


def link_mismatch(spark, d):
    owned = V.vehicles(spark, d).filter("model <> '5-LOW'")
    return E.link_mismatches(V.links(spark, d), owned)


def case_model_match(spark, d):
    asked = V.requests(spark, d)
    hits = text_topk(V.case_index(spark, d), asked, 3, attributes=["customer_id"])
    hits = hits.select("request_id", "customer_id", "rank", F.col("id").alias("case_id"))
    return E.match_case_models(
        hits, V.cases(spark, d), V.links(spark, d), V.vehicles(spark, d)
    ).select("request_id", "customer_id", "rank", "case_id", "model_match")


def members(spark, d):
    """Customers with their first and last order date, and the price of the dearest order."""
    orders = V.table(spark, d, "orders").groupBy(
        V.coded("C", F.col("o_custkey")).alias("customer_id")
    ).agg(
        F.date_format(F.min("o_orderdate"), "yyyy/MM/dd").alias("member_since"),
        F.date_format(F.max("o_orderdate"), "yyyy/MM/dd").alias("last_purchase"),
        F.max("o_totalprice").alias("price"),
    )
    return TR.member_dates(
        V.customers(spark, d).join(orders, "customer_id"), "member_since", "last_purchase"
    )


def warranty(spark, d):
    bought = V.vehicles(spark, d).withColumn("bought", slash_date(F.col("purchase_date")))
    as_of = F.to_date(F.lit(V.AS_OF))
    return bought.select(
        "vehicle_id",
        warranty_state(F.add_months("bought", 36), as_of).alias("basic"),
        warranty_state(
            F.when(F.col("model") != "5-LOW", F.add_months("bought", 60)), as_of
        ).alias("powertrain"),
    )


def discounted_price(spark, d):
    priced = TR.with_benefits(members(spark, d))
    return priced.select(
        "customer_id", "tier",
        *[
            TR.discounted(F.col("price"), F.col(f"{kind}_pct")).alias(kind)
            for kind in ("maintenance", "inspection", "extended_warranty")
        ],
    )


def upgrade_eligible(spark, d):
    as_of = F.to_date(F.lit(V.AS_OF))
    yes = TR.upgrade_eligible(
        F.col("tier"), F.col("member_since"), F.col("last_purchase"), as_of
    )
    # Purchases after the date in question are not known yet.
    known = members(spark, d).withColumn(
        "last_purchase", F.when(F.col("last_purchase") <= as_of, F.col("last_purchase"))
    )
    return known.select(
        "customer_id", "tier", yes.alias("eligible"),
        F.when(yes, F.date_format(TR.upgrade_effective(as_of), "yyyy-MM-dd")).alias("effective"),
    )


def assemble(spark, d):
    return assemble_messages(V.table(spark, d, "conversations"), V.PROMPT)


def feedback(spark, d):
    events = V.table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kind = F.col("event_type")
    return feedback_counts(events, "day", kind == "purchase", kind == "error")


def round_cap(spark, d):
    events = V.table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return cap_rounds(events, C.MAX_ROUNDS, "user_id", order=[F.asc("ts")]).select(
        "user_id", "event_id", "event_type", "round"
    )


_ARGS = [
    "customer_id", "vehicle_id", "query", "customer_tier", "num_results", "service_type",
    "preferred_date", "notes",
]


def parse_args(spark, d):
    parsed = T.parse_arguments(V.calls(spark, d))
    return parsed.select("call_id", "name", *[F.col(f"args.{a}").alias(a) for a in _ARGS])


def args_check(spark, d):
    parsed = T.parse_arguments(V.calls(spark, d))
    return parsed.select(
        "call_id", "name", F.array_join(T.argument_violations(), ", ").alias("violations")
    )


def booking_rows(spark, d):
    return T.bookings(V.calls(spark, d))


def tool_dispatch(spark, d):
    return T.run_tools(V.calls(spark, d), tool_data(spark, d))


def tool_stats(spark, d):
    return T.tool_stats(T.tool_outcomes(V.calls(spark, d), V.customers(spark, d), V.vehicles(spark, d)))


def context(spark, d):
    return build_context(
        V.requests(spark, d), tool_data(spark, d), V.links(spark, d), V.PROMPT
    )


QUERIES = {
    "enrich_customer": enrich_customer,
    "enrich_vehicles": enrich_vehicles,
    "tier_benefits": tier_benefits,
    "link_mismatch": link_mismatch,
    "case_model_match": case_model_match,
    "warranty_state": warranty,
    "discounted_price": discounted_price,
    "upgrade_eligible": upgrade_eligible,
    "assemble_messages": assemble,
    "feedback_counts": feedback,
    "round_cap": round_cap,
    "parse_args": parse_args,
    "args_check": args_check,
    "booking_rows": booking_rows,
    "tool_dispatch": tool_dispatch,
    "tool_stats": tool_stats,
    "build_context": context,
}

_BENEFITS = """benefits(tier, maintenance_pct, trade_in_pct, inspection_pct,
  extended_warranty_pct, towing_km, cover_abroad, loan_car, priority_booking, own_contact) AS (
  VALUES ('standard', 0, 0, 0, 0, 50, false, false, false, false),
         ('silver', 15, 5, 15, 10, 100, false, false, false, false),
         ('gold', 20, 10, 20, 20, NULL, true, true, true, true))"""
_MEMBERS = """members AS (SELECT customer_id, tier, since, last, price FROM cust JOIN
  (SELECT 'C' || lpad(o_custkey::VARCHAR, 9, '0') AS customer_id, min(o_orderdate)::DATE AS since,
     max(o_orderdate)::DATE AS last, max(o_totalprice) AS price FROM orders GROUP BY 1)
  USING (customer_id))"""
_D = S.corpus("d", "documents", "doc_id")
_CASE_HITS = [
    S.REQ, S.CASES, _D, S.ranked("s", "d", "req", "request_id"), S.best("b", "s", 3),
]
_WARRANTY = """CASE WHEN {e} IS NULL THEN NULL WHEN {e} < DATE '1998-06-30' THEN 'expired'
  WHEN {e} <= DATE '1998-09-30' THEN 'ending' ELSE 'valid' END"""

# The searches of all valid calls, by distinct (query, tier).
_LOG = [
    S.CUST, S.VEH, S.KB, S.CASES, S.CALLS, _D,
    "asks AS (SELECT DISTINCT query AS text, item_id FROM calls JOIN benchmark ON query = text)",
    "firsts AS (SELECT min(item_id) AS ask, text FROM asks GROUP BY text)",
    S.ranked("s", "d", "firsts", "ask"),
    """top AS (SELECT ask, text, rank, s2.id, score FROM (SELECT *, row_number() OVER
      (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s) s2 JOIN firsts ON ask = q
      WHERE rank <= 6)""",
    """faq_hits AS (SELECT call_id, num_results, row_number() OVER (PARTITION BY call_id
        ORDER BY score DESC, kb.id) AS rank, {'id': kb.id, 'category': category,
        'question': question, 'answer': answer, 'applicable_tier': applicable_tier} AS hit
      FROM checked JOIN top ON top.text = query AND rank <= 2 * num_results
      JOIN kb ON kb.id = top.id WHERE name = 'search_faq' AND violations = '' AND round <= 5
        AND (applicable_tier = 'all' OR contains(applicable_tier, customer_tier)))""",
    """case_hits AS (SELECT call_id, rank, {'case_id': case_id, 'title': title,
        'symptoms': symptoms, 'solution': solution, 'cost_estimate': cost_estimate,
        'resolution_time': resolution_time} AS hit
      FROM checked JOIN top ON top.text = query AND rank <= num_results
      JOIN cases ON case_id = top.id
      WHERE name = 'search_service_cases' AND violations = '' AND round <= 5)""",
    """hits AS (SELECT call_id, to_json(list(hit ORDER BY rank))::VARCHAR AS content FROM (
      SELECT call_id, rank, hit FROM faq_hits WHERE rank <= num_results) GROUP BY call_id
      UNION ALL SELECT call_id, to_json(list(hit ORDER BY rank))::VARCHAR FROM case_hits
      GROUP BY call_id)""",
    """log AS (SELECT request_id, round, call_id, a.name, CASE WHEN a.name LIKE 'search%'
        THEN 'retriever' WHEN a.name <> 'no_such_tool' THEN 'tool' END AS span_type,
      CASE WHEN a.name = 'no_such_tool' THEN '未定義: ' || a.name
        WHEN violations <> '' THEN '引数エラー: ' || violations
        WHEN a.name = 'get_customer_info' AND cust.customer_id IS NULL
          THEN '顧客ID ''' || a.customer_id || ''' が見つかりません。'
        WHEN a.name = 'get_vehicle_info' AND veh.vehicle_id IS NULL
          THEN '車両ID ''' || a.vehicle_id || ''' が見つかりません。' END AS error,
      CASE WHEN error IS NOT NULL THEN to_json({'error': error})::VARCHAR
        WHEN a.name = 'get_customer_info' THEN to_json({'customer_id': cust.customer_id,
          'name': cust.name, 'tier': cust.tier})::VARCHAR
        WHEN a.name = 'get_vehicle_info' THEN to_json({'vehicle_id': veh.vehicle_id,
          'owner_id': owner_id, 'model': model, 'purchase_date': purchase_date})::VARCHAR
        WHEN a.name LIKE 'search%' THEN coalesce(hits.content, '[]')
        ELSE to_json({'booking_id': booking_id, 'status': 'confirmed',
          'message': '予約を受け付けました。予約番号: ' || booking_id,
          'customer_id': a.customer_id, 'vehicle_id': a.vehicle_id,
          'service_type': a.service_type, 'scheduled_date': a.preferred_date,
          'notes': a.notes,
          'reminder': '前日にSMSまたはメールにてリマインドをお送りします'})::VARCHAR END AS content
      FROM checked a
      LEFT JOIN cust ON cust.customer_id = a.customer_id
      LEFT JOIN veh ON veh.vehicle_id = a.vehicle_id
      LEFT JOIN hits USING (call_id)
      LEFT JOIN (SELECT call_id, booking_id FROM booked) USING (call_id)
      WHERE round <= 5)""",
]
SQL = {
    "enrich_customer": S.with_(S.REQ, S.CUST) + """SELECT request_id, r.customer_id, name, tier,
        text, CASE WHEN c.customer_id IS NULL
          THEN '顧客ID ''' || r.customer_id || ''' が見つかりません。' END AS error
        FROM req r LEFT JOIN cust c USING (customer_id)""",
    "enrich_vehicles": S.with_(S.REQ, S.VEH, S.LINKS) + """SELECT request_id, r.customer_id,
        l.vehicle_id, model, purchase_date FROM req r LEFT JOIN links l USING (customer_id)
        LEFT JOIN veh v ON v.vehicle_id = l.vehicle_id""",
    "tier_benefits": S.with_(S.CUST, _BENEFITS)
    + "SELECT customer_id, benefits.* FROM cust JOIN benefits USING (tier)",
    "link_mismatch": S.with_(S.VEH, S.LINKS) + """SELECT customer_id, vehicle_id,
        'listed_not_owned' AS problem FROM (SELECT customer_id, vehicle_id FROM links EXCEPT
          SELECT owner_id, vehicle_id FROM veh WHERE model <> '5-LOW')
        UNION ALL SELECT owner_id, vehicle_id, 'owned_not_listed' FROM (
          SELECT owner_id, vehicle_id FROM veh WHERE model <> '5-LOW'
          EXCEPT SELECT customer_id, vehicle_id FROM links)""",
    "case_model_match": S.with_(*_CASE_HITS, S.VEH, S.LINKS, """owned AS (SELECT customer_id,
        list(DISTINCT model) AS models FROM links JOIN veh USING (vehicle_id) GROUP BY 1)""")
    + """SELECT request_id, customer_id, rank, case_id,
        list_contains(applicable_models, '全モデル')
          OR coalesce(list_has_any(applicable_models, models), false) AS model_match
        FROM b JOIN req ON request_id = q JOIN cases ON case_id = id
        LEFT JOIN owned USING (customer_id)""",
    "warranty_state": S.with_(S.VEH) + "SELECT vehicle_id, "
    + _WARRANTY.format(e="basic_end") + " AS basic, "
    + _WARRANTY.format(e="power_end") + """ AS powertrain FROM (SELECT vehicle_id,
        (day + INTERVAL 36 MONTH)::DATE AS basic_end,
        CASE WHEN model <> '5-LOW' THEN (day + INTERVAL 60 MONTH)::DATE END AS power_end
        FROM (SELECT *, strptime(purchase_date, '%Y/%m/%d')::DATE AS day FROM veh))""",
    "discounted_price": S.with_(S.CUST, _BENEFITS, _MEMBERS) + """SELECT customer_id, tier,
        round(price * (100 - maintenance_pct) / 100, 2) AS maintenance,
        round(price * (100 - inspection_pct) / 100, 2) AS inspection,
        round(price * (100 - extended_warranty_pct) / 100, 2) AS extended_warranty
        FROM members JOIN benefits USING (tier)""",
    "upgrade_eligible": S.with_(S.CUST, _MEMBERS) + """SELECT customer_id, tier, eligible,
        CASE WHEN eligible THEN '1998-07-01' END AS effective FROM (SELECT *, tier = 'silver' AND
          (since + INTERVAL 60 MONTH <= DATE '1998-06-30'
           OR coalesce(last <= DATE '1998-06-30' AND last >= DATE '1995-06-30', false))
          AS eligible FROM members)""",
    "assemble_messages": """SELECT conv_id, 0::BIGINT AS position, 'system' AS role,
          'Answer politely and only from the records below.' AS content
        FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL SELECT conv_id, turn + 1, role, text FROM conversations""",
    "feedback_counts": """SELECT strftime(ts, '%Y-%m-%d') AS day,
        count(*) FILTER (event_type = 'purchase') AS up,
        count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY 1""",
    "round_cap": """SELECT user_id, event_id, event_type, round FROM (SELECT *, (dense_rank()
        OVER (PARTITION BY user_id ORDER BY ts))::INTEGER AS round FROM events) WHERE round <= 5""",
    "parse_args": S.with_(S.CALLS) + f"SELECT call_id, name, {', '.join(_ARGS)} FROM calls",
    "args_check": S.with_(S.CALLS) + "SELECT call_id, name, violations FROM checked",
    "booking_rows": S.with_(S.CALLS) + """SELECT call_id, booking_id, 'confirmed' AS status,
        '予約を受け付けました。予約番号: ' || booking_id AS message, customer_id, vehicle_id,
        service_type, preferred_date AS scheduled_date, notes,
        '前日にSMSまたはメールにてリマインドをお送りします' AS reminder FROM booked""",
    "tool_dispatch": S.with_(*_LOG)
    + "SELECT request_id, round, call_id, name, content, error, span_type FROM log",
    "tool_stats": S.with_(*_LOG) + """SELECT name, span_type, count(*) AS calls,
        count(error) AS errors FROM log GROUP BY 1, 2""",
    "build_context": S.with_(
        S.CUST, S.VEH, S.LINKS, S.KB, *_CASE_HITS,
        """f AS (SELECT q, s.id, score, applicable_tier, category, question, answer, tier
          FROM s JOIN req ON request_id = q LEFT JOIN cust USING (customer_id)
          JOIN kb ON kb.id = s.id)""",
        S.best("f6", "f", 6),
        """f3 AS (SELECT * EXCLUDE (rank) FROM f6 WHERE applicable_tier = 'all'
          OR contains(applicable_tier, coalesce(tier, 'standard')))""",
        S.best("fb", "f3", 3),
    ) + """SELECT request_id, 0 AS part, 0::BIGINT AS position, NULL AS ref_id, 'system' AS role,
          'Answer politely and only from the records below.' AS content FROM req
        UNION ALL SELECT request_id, 1, 0, NULL, 'user', text FROM req
        UNION ALL SELECT request_id, 2, 0, customer_id, 'tool', coalesce(CASE WHEN name IS NOT NULL
          THEN to_json({'customer_id': customer_id, 'name': name, 'tier': tier})::VARCHAR END,
          to_json({'error': '顧客ID ''' || customer_id || ''' が見つかりません。'})::VARCHAR)
          FROM req LEFT JOIN cust USING (customer_id)
        UNION ALL SELECT request_id, 3, position, vehicle_id, 'tool', to_json({
          'vehicle_id': vehicle_id, 'owner_id': owner_id, 'model': model,
          'purchase_date': purchase_date})::VARCHAR
          FROM req JOIN links USING (customer_id) JOIN veh USING (vehicle_id)
        UNION ALL SELECT q, 4, rank, id::VARCHAR, 'tool', to_json({'id': id,
          'category': category, 'question': question, 'answer': answer,
          'applicable_tier': applicable_tier})::VARCHAR FROM fb
        UNION ALL SELECT q, 5, rank, case_id::VARCHAR, 'tool', to_json({'case_id': case_id,
          'title': title, 'symptoms': symptoms, 'solution': solution,
          'cost_estimate': cost_estimate, 'resolution_time': resolution_time})::VARCHAR
          FROM b JOIN cases ON case_id = id""",
}
