"""SQL for DuckDB that says the same as the views and the search, in plain joins."""

from __future__ import annotations

KB = """kb AS (SELECT doc_id AS id, source AS category, lang AS question, text AS answer, text,
  CASE doc_id % 5 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN 'standard' ELSE 'all' END
    AS applicable_tier FROM documents)"""
CASES = """cases AS (SELECT doc_id AS case_id, source AS title, lang AS symptoms, text AS solution,
  n_chars || '円' AS cost_estimate, nullif(lang, 'en') AS resolution_time, text,
  CASE WHEN doc_id % 7 = 0 THEN ['全モデル'] ELSE CASE doc_id % 5
    WHEN 0 THEN ['1-URGENT', '2-HIGH'] WHEN 1 THEN ['2-HIGH', '3-MEDIUM']
    WHEN 2 THEN ['3-MEDIUM', '4-NOT SPECIFIED'] WHEN 3 THEN ['4-NOT SPECIFIED', '5-LOW']
    ELSE ['5-LOW', '1-URGENT'] END END AS applicable_models FROM documents)"""
CUST = """cust AS (SELECT 'C' || lpad(c_custkey::VARCHAR, 9, '0') AS customer_id, c_name AS name,
  CASE WHEN c_acctbal >= 6000 THEN 'gold' WHEN c_acctbal >= 2000 THEN 'silver'
    ELSE 'standard' END AS tier FROM customer)"""
VEH = """veh AS (SELECT 'V' || lpad(o_orderkey::VARCHAR, 9, '0') AS vehicle_id,
  'C' || lpad(o_custkey::VARCHAR, 9, '0') AS owner_id, o_orderpriority AS model,
  strftime(o_orderdate, '%Y/%m/%d') AS purchase_date FROM orders)"""
LINKS = """links AS (SELECT 'C' || lpad(o_custkey::VARCHAR, 9, '0') AS customer_id,
  o_orderkey AS position, 'V' || lpad(o_orderkey::VARCHAR, 9, '0') AS vehicle_id
  FROM orders WHERE o_orderstatus <> 'P')"""
REQ = """req AS (SELECT conv_id AS request_id, 'C' || lpad(conv_id::VARCHAR, 9, '0') AS customer_id,
  arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)"""
PAIRS = """pairs AS (SELECT u.conv_id || '-' || u.turn AS request_id,
  'C' || lpad(u.conv_id::VARCHAR, 9, '0') AS customer_id, u.text AS question, a.text AS response,
  l.expected_response, coalesce(d.text, '') AS ground_truth_context
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  JOIN (SELECT conv_id, arg_max(text, turn) AS expected_response FROM conversations
        WHERE role = 'assistant' GROUP BY conv_id) l ON l.conv_id = u.conv_id
  LEFT JOIN documents d ON d.doc_id = u.conv_id
  WHERE u.role = 'user')"""
SCORES = """scores AS (SELECT doc_id, (1.0 + 4 * quality)::DOUBLE AS quality,
  (5.0 - 4 * toxic)::DOUBLE AS safety,
  CASE WHEN toxic = 0 THEN 1.0 + 2.5 * quality END::DOUBLE AS relevance FROM labels),
long AS (SELECT doc_id, 'quality/score' AS metric, quality AS score FROM scores
  UNION ALL SELECT doc_id, 'safety/score', safety FROM scores
  UNION ALL SELECT doc_id, 'relevance/score', relevance FROM scores)"""
CALLS = """calls AS (SELECT user_id AS request_id, (k // 15 + 1)::INTEGER AS round,
  event_id AS call_id,
  CASE event_type WHEN 'click' THEN 'get_customer_info' WHEN 'view' THEN 'get_vehicle_info'
    WHEN 'purchase' THEN 'book_service_appointment'
    WHEN 'signup' THEN CASE WHEN k < 50 THEN 'search_faq' ELSE 'search_service_cases' END
    ELSE 'no_such_tool' END AS name,
  CASE WHEN event_type IN ('click', 'purchase')
    THEN 'C' || lpad((k * 20)::VARCHAR, 9, '0') END AS customer_id,
  CASE WHEN event_type IN ('view', 'purchase')
    THEN 'V' || lpad((user_id * 101 + k)::VARCHAR, 9, '0') END AS vehicle_id,
  CASE WHEN event_type = 'purchase' THEN 'inspection' END AS service_type,
  CASE WHEN event_type = 'purchase' AND value >= 2 THEN '2024/05/01' END AS preferred_date,
  CASE WHEN event_type = 'purchase' THEN '' END AS notes,
  CASE WHEN event_type = 'signup' THEN text END AS query,
  CASE WHEN event_type = 'signup' AND k < 50 THEN CASE WHEN value < 5 THEN 'gold'
    WHEN value < 10 THEN 'silver' WHEN value < 30 THEN 'standard' ELSE 'platinum' END END
    AS customer_tier,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k < 10 THEN 2 ELSE 3 END END AS num_results, k
  FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) e
  LEFT JOIN benchmark ON item_id = k % 50 AND event_type = 'signup'),
checked AS (SELECT *, concat_ws(', ',
  CASE WHEN name IN ('get_customer_info', 'book_service_appointment') AND customer_id IS NULL
    THEN 'missing customer_id' END,
  CASE WHEN name IN ('get_vehicle_info', 'book_service_appointment') AND vehicle_id IS NULL
    THEN 'missing vehicle_id' END,
  CASE WHEN name LIKE 'search%' AND query IS NULL THEN 'missing query' END,
  CASE WHEN name = 'search_faq' AND customer_tier IS NULL THEN 'missing customer_tier' END,
  CASE WHEN customer_tier = 'platinum' THEN 'invalid customer_tier' END,
  CASE WHEN name = 'search_service_cases' AND k < 55 THEN 'wrong type num_results' END,
  CASE WHEN name = 'book_service_appointment' AND service_type IS NULL
    THEN 'missing service_type' END,
  CASE WHEN name = 'book_service_appointment' AND preferred_date IS NULL
    THEN 'missing preferred_date' END) AS violations FROM calls),
booked AS (SELECT *,
  'SV' || (('0x' || substr(md5(call_id::VARCHAR), 1, 7))::BIGINT % 90000 + 10000) AS booking_id
  FROM checked WHERE name = 'book_service_appointment' AND violations = '')"""

WORD = r"[\p{L}\p{N}]+"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def corpus(name: str, source: str, key: str) -> str:
    """Token weights of a table of passages: {name}_w(id, token, tf, w) and {name}_df."""
    return f"""{name}_tf AS (SELECT id, token, count(*) AS tf FROM (SELECT {key} AS id,
    unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM {source}) GROUP BY 1, 2),
{name}_n AS (SELECT count(*) AS n FROM {source}),
{name}_df AS (SELECT token, count(*) AS df, any_value(ln((n + 1) / (df0 + 1)) + 1) AS idf
  FROM (SELECT token, n, count(*) OVER (PARTITION BY token) AS df0 FROM {name}_tf, {name}_n)
  GROUP BY token),
{name}_r AS (SELECT id, token, tf, tf * idf AS w FROM {name}_tf JOIN {name}_df USING (token)),
{name}_w AS (SELECT r.id, token, tf, w / norm AS w FROM {name}_r r JOIN
  (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}_r GROUP BY id) USING (id))"""


def ranked(name: str, index: str, source: str, key: str) -> str:
    """All scores of a table of requests: {name}(q, id, score)."""
    return f"""{name}_tf AS (SELECT q, token, count(*) AS tf FROM (SELECT {key} AS q,
    unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM {source}) GROUP BY 1, 2),
{name}_r AS (SELECT q, token, tf * coalesce(idf, ln(n + 1) + 1) AS w
  FROM {name}_tf LEFT JOIN {index}_df USING (token), {index}_n),
{name}_q AS (SELECT r.q, token, w / norm AS w FROM {name}_r r JOIN
  (SELECT q, sqrt(sum(w * w)) AS norm FROM {name}_r GROUP BY q) USING (q)),
{name} AS (SELECT a.q, b.id, round(sum(a.w * b.w), 6) AS score
  FROM {name}_q a JOIN {index}_w b USING (token) GROUP BY 1, 2)"""


def best(name: str, source: str, k: int, where: str = "true", keys: str = "q") -> str:
    """The first k of each request."""
    return f"""{name} AS (SELECT * FROM (SELECT *, (row_number() OVER
  (PARTITION BY {keys} ORDER BY score DESC, id))::INTEGER AS rank FROM {source} WHERE {where})
  WHERE rank <= {k})"""


def _pairs(name: str, source: str, key: str, id: str) -> str:
    """Buckets of neighbouring characters and how often each comes: {name}(id, bucket, n)."""
    return f"""{name} AS (SELECT {id}, bucket, count(*) AS n FROM (SELECT {id},
    ((unicode(p[1])::BIGINT * 65599 + unicode(p[2])) * 40503 % 65536 % 256)::INTEGER AS bucket FROM (
      SELECT {id}, substr(t, i::INTEGER, 2) AS p FROM (SELECT {id}, t, unnest(range(1, length(t))) AS i
        FROM (SELECT {key} AS {id}, lower(text) AS t FROM {source})))
    WHERE regexp_full_match(p, '(?s)[^\\x20\\x09-\\x0D]{{2}}')) GROUP BY 1, 2)"""


def pair_vectors(name: str, source: str, key: str) -> list[str]:
    """Unit vectors of a table of texts: {name}_v(id, bucket, value), {name}_m(bucket, weight)."""
    return [
        _pairs(f"{name}_p", source, key, "id"),
        f"""{name}_m AS (SELECT bucket, ln((n + 1) / (df + 1)) + 1 AS weight FROM
  (SELECT bucket, count(*) AS df FROM {name}_p GROUP BY 1), (SELECT count(*) AS n FROM {source}))""",
        f"""{name}_v AS (SELECT id, bucket, (n * weight / sqrt(sum(n * weight * n * weight) OVER (PARTITION BY id)))::FLOAT::DOUBLE
  AS value FROM {name}_p JOIN {name}_m USING (bucket))""",
    ]


def pair_scores(name: str, index: str, source: str, key: str) -> str:
    """All scores of requests by these vectors: {name}(q, id, score), 0 for texts without a common pair.

    Buckets that no stored text has weigh as much as if none had been counted.
    """
    return f"""{_pairs(f"{name}_p", source, key, "q")},
{name}_r AS (SELECT q, bucket, n * coalesce(weight, ln(total + 1) + 1) AS w FROM {name}_p
  LEFT JOIN {index}_m USING (bucket), (SELECT count(*) AS total FROM documents)),
{name}_v AS (SELECT q, bucket, (w / sqrt(sum(w * w) OVER (PARTITION BY q)))::FLOAT::DOUBLE AS value FROM {name}_r),
{name} AS (SELECT q, id, round(coalesce(score, 0), 6) AS score FROM
  (SELECT {key} AS q, doc_id AS id FROM {source}, documents) LEFT JOIN
  (SELECT a.q, b.id, sum(a.value * b.value) AS score FROM {name}_v a JOIN {index}_v b USING (bucket) GROUP BY 1, 2)
  USING (q, id))"""


ALLOWS = "(applicable_tier = 'all' OR contains(applicable_tier, customer_tier))"
