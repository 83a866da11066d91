"""Queries over answers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from hibiki import constants as C
from hibiki.catalog import sql as S
from hibiki.catalog import views as V
from hibiki.functions.scores import safety_rule, tier_rule
from hibiki.operators import evaluation as E
from hibiki.operators.answers import apply_answers
from hibiki.operators.text_search import text_topk, with_passages
from hibiki.plans.evaluate import TIER_COMPLIANCE, evaluate

# Words of the test tables' language in the place of the Japanese ones.
WORDS = {
    "safety": ["the", "der", "les"],
    "defer": ["hein", "heit"],
    "urgent": ["ing", "ung", "eau"],
    "action": ["that", "ver", "pour"],
}


def low_scores(spark, d):
    return E.low_scores(E.long_scores(V.scores(spark, d), ["doc_id"]))


def score_cols(spark, d):
    wide = V.scores(spark, d)
    return E.select_quoted(wide, E.display_columns(wide, ["doc_id", "response"]))


def scores_long(spark, d):
    return E.long_scores(V.scores(spark, d), ["doc_id"])


def low_counts(spark, d):
    return E.low_counts(scores_long(spark, d))


def metric_summary(spark, d):
    return E.metric_summary(scores_long(spark, d)).select(
        "metric", F.round("mean_score", 6).alias("mean_score"), "n_scores"
    )


def summary_lines(spark, d):
    return E.summary_lines(E.metric_summary(scores_long(spark, d)))


def low_report(spark, d):
    text = V.table(spark, d, "documents").select("doc_id", F.col("text").alias("question"))
    wide = V.scores(spark, d).join(text, "doc_id")
    return E.low_report(E.long_scores(wide, ["doc_id", "question"]))


def eval_flatten(spark, d):
    message = F.struct("role", F.col("text").alias("content"))
    items = V.table(spark, d, "conversations").select(
        "conv_id", "turn", F.struct(F.array(message).alias("messages")).alias("request"),
        F.when(F.col("role") == "user", F.col("text")).alias("expected_response"),
        F.lit(None).cast("string").alias("ground_truth_context"),
    )
    return E.flatten_eval(items)


def eval_align(spark, d):
    rows = V.pairs(spark, d)
    answers = rows.filter("response <> expected_response").select("request_id", "response")
    expected = E.rename_columns(
        rows.select("request_id", "question", "expected_response", "ground_truth_context"),
        {"inputs": "question", "context": "ground_truth_context"},
    )
    return E.align(answers, expected)


def token_f1(spark, d):
    return E.token_f1(V.pairs(spark, d), "request_id", "response", "expected_response")


def exact_match(spark, d):
    return V.pairs(spark, d).select(
        "request_id",
        E.exact_match(F.col("response"), F.col("expected_response")).alias("exact_match"),
    )


def lexical_relevance(spark, d):
    return E.lexical_relevance(
        V.pairs(spark, d), "request_id", "question", "response", V.kb_index(spark, d)
    )


def context_support(spark, d):
    return E.context_support(
        V.pairs(spark, d), "request_id", "response", "ground_truth_context"
    )


def tier_rule_(spark, d):
    percent = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    text = F.when(F.col("l_returnflag") == "N", "no discount").otherwise(
        F.concat(percent("l_discount"), F.lit("% off, fee "), percent("l_tax"), F.lit("%"))
    )
    orders = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        V.coded("C", F.col("o_custkey")).alias("customer_id"),
    )
    return (
        V.table(spark, d, "lineitem").withColumn("response", text)
        .join(orders, "l_orderkey")
        .join(V.customers(spark, d), "customer_id")
        .select(
            "l_orderkey", "l_linenumber", "tier", "response",
            tier_rule(F.col("response"), F.col("tier")).alias("score"),
        )
    )


def safety_rule_(spark, d):
    return V.pairs(spark, d).select(
        "request_id", safety_rule(F.col("question"), F.col("response"), **WORDS).alias("score")
    )


def judge_prompt(spark, d):
    return E.judge_prompts(
        V.pairs(spark, d), TIER_COMPLIANCE, "request_id", "question", "response",
        "expected_response",
    )


def score_check(spark, d):
    expected = V.table(spark, d, "documents").select(
        "doc_id", F.explode(F.array(F.lit("quality"), F.lit("safety"))).alias("metric")
    )
    labels = V.table(spark, d, "labels")
    scores = labels.select(
        "doc_id", F.lit("quality").alias("metric"), (1.0 + 5 * F.col("quality")).alias("score")
    ).unionByName(
        labels.select(
            "doc_id", F.lit("safety").alias("metric"), (5.0 - 4 * F.col("toxic")).alias("score")
        )
    )
    # A quarter of the documents was not sent out, and a tenth was scored twice.
    expected = expected.filter("doc_id % 4 <> 1")
    scores = scores.unionByName(scores.filter("doc_id % 10 = 3"))
    return E.take_scores(expected, scores, "doc_id")


def best_passage(texts: list[str]) -> list[str]:
    """An answer function for tests: it fails on passages in French."""
    if any("eau" in t for t in texts):
        raise ValueError("cannot read this")
    return [f"{len(t)}: {t}" for t in texts]


def answer_rows(spark, d):
    asked = V.requests(spark, d)
    best = text_topk(V.kb_index(spark, d), asked, 1).select("request_id", "id")
    passages = with_passages(best, V.kb(spark, d), "id", "answer").select("request_id", "answer")
    return apply_answers(passages, best_passage, "answer")


def evaluate_summary(spark, d):
    tiers = V.customers(spark, d).select("customer_id", "tier")
    rows = V.pairs(spark, d).join(tiers, "customer_id", "left")
    done = evaluate(rows, V.kb_index(spark, d))
    return done.summary.select("metric", F.round("mean_score", 4).alias("mean_score"), "n_scores")


QUERIES = {
    "low_scores": low_scores,
    "score_cols": score_cols,
    "scores_long": scores_long,
    "low_counts": low_counts,
    "metric_summary": metric_summary,
    "summary_lines": summary_lines,
    "low_report": low_report,
    "eval_flatten": eval_flatten,
    "eval_align": eval_align,
    "token_f1": token_f1,
    "exact_match": exact_match,
    "lexical_relevance": lexical_relevance,
    "context_support": context_support,
    "tier_rule": tier_rule_,
    "safety_rule": safety_rule_,
    "judge_prompt": judge_prompt,
    "score_check": score_check,
    "answer_rows": answer_rows,
    "evaluate_summary": evaluate_summary,
}

_D = S.corpus("d", "documents", "doc_id")
_TOKENS = f"""tok AS (SELECT request_id, token, count(*) FILTER (part = 'q') AS q,
  count(*) FILTER (part = 'r') AS r, count(*) FILTER (part = 'e') AS e,
  count(*) FILTER (part = 'c') AS c FROM (
    SELECT request_id, part, unnest(regexp_extract_all(lower(text), '{S.WORD}')) AS token FROM (
      SELECT request_id, 'q' AS part, question AS text FROM pairs
      UNION ALL SELECT request_id, 'r', response FROM pairs
      UNION ALL SELECT request_id, 'e', expected_response FROM pairs
      UNION ALL SELECT request_id, 'c', ground_truth_context FROM pairs)) GROUP BY 1, 2)"""
_F1 = """f1 AS (SELECT request_id, sum(least(r, e)) AS same, sum(r) AS r, sum(e) AS e
  FROM tok GROUP BY 1)"""
_REL = """rel AS (SELECT request_id, coalesce(sum(q * r * i * i)
    / nullif(sqrt(sum(q * q * i * i)) * sqrt(sum(r * r * i * i)), 0), 0) AS relevance
  FROM (SELECT tok.*, coalesce(idf, ln(n + 1) + 1) AS i FROM tok LEFT JOIN d_df USING (token), d_n)
  GROUP BY 1)"""
_SUP = """sup AS (SELECT request_id, coalesce(sum(CASE WHEN c > 0 THEN r ELSE 0 END)
    / nullif(sum(r), 0), 0) AS support FROM tok GROUP BY 1)"""


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _safety(words: dict[str, list[str]]) -> str:
    return f"""CASE WHEN NOT {_any('question', words['safety'])} THEN 5
      WHEN {_any('response', words['defer'])} THEN 1
      WHEN {_any('response', words['urgent'])} AND {_any('response', words['action'])} THEN 5
      WHEN {_any('response', words['urgent'])} THEN 4
      WHEN {_any('response', words['safety'])} THEN 3 ELSE 2 END"""


_TIER = """CASE WHEN len(p) = 0 THEN 3 ELSE CASE len(list_filter(list_distinct(p), lambda x: NOT list_contains(
      CASE tier WHEN 'gold' THEN [10, 20] WHEN 'silver' THEN [5, 10, 15] WHEN 'standard' THEN [0]
        ELSE [] END, x))) WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END END"""
_PERCENT = "list_transform(regexp_extract_all({c}, '([0-9]+)\\s*%', 1), lambda x: x::INTEGER)"
_JUDGE = TIER_COMPLIANCE

_LONG = """long AS (SELECT 'tier_percentages/score' AS metric, tier_percentages AS score FROM m
          UNION ALL SELECT 'safety_words/score', safety_words FROM m
          UNION ALL SELECT 'exact_match/score', exact_match FROM m
          UNION ALL SELECT 'token_f1/score', 1 + 4 * round(coalesce(2 * same / nullif(r + e, 0), 0), 6)
            FROM f1
          UNION ALL SELECT 'lexical_relevance/score', 1 + 4 * round(relevance, 6) FROM rel
          UNION ALL SELECT 'context_support/score', 1 + 4 * round(support, 6) FROM sup)"""

SQL = {
    "low_scores": S.with_(S.SCORES) + "SELECT * FROM long WHERE score < 3.5",
    "score_cols": S.with_(S.SCORES) + """SELECT doc_id, quality AS "quality/score",
        safety AS "safety/score", relevance AS "relevance/score" FROM scores""",
    "scores_long": S.with_(S.SCORES) + "SELECT * FROM long",
    "low_counts": S.with_(S.SCORES)
    + "SELECT metric, count(*) AS n_low FROM long WHERE score < 3.5 GROUP BY 1",
    "metric_summary": S.with_(S.SCORES) + """SELECT metric, round(avg(score), 6) AS mean_score,
        count(score) AS n_scores FROM long GROUP BY 1""",
    "summary_lines": S.with_(S.SCORES) + """SELECT metric, repeat('█', v::DECIMAL(9, 6)::INTEGER
          - CASE WHEN round(v) > v THEN 1 ELSE 0 END) || repeat('░', 5 - floor(least(v, 5))::INTEGER)
          AS bar, '  ' || rpad(metric, 45, ' ') || ': ' || bar || ' ' || printf('%.2f', v)
          || '/5.00' AS line
        FROM (SELECT metric, avg(score) AS v FROM long GROUP BY 1)""",
    "low_report": S.with_(S.SCORES) + """SELECT metric, left(text, 80) || '...' AS question,
        '  質問: ' || left(text, 80) || '... | スコア: ' || printf('%.1f', score) AS line
        FROM long JOIN documents USING (doc_id) WHERE score < 3.5""",
    "eval_flatten": """SELECT conv_id, turn,
        to_json({'messages': [{'role': role, 'content': text}]})::VARCHAR AS request,
        CASE WHEN role = 'user' THEN text ELSE '' END AS expected_response,
        '' AS ground_truth_context, text AS question FROM conversations""",
    "eval_align": S.with_(S.PAIRS) + """SELECT request_id, question AS inputs, expected_response,
        ground_truth_context AS context,
        CASE WHEN response <> expected_response THEN response END AS response FROM pairs""",
    "token_f1": S.with_(S.PAIRS, _TOKENS, _F1) + """SELECT request_id,
        round(coalesce(same / nullif(r, 0), 0), 6) AS precision,
        round(coalesce(same / nullif(e, 0), 0), 6) AS recall,
        round(coalesce(2 * same / nullif(r + e, 0), 0), 6) AS f1 FROM f1""",
    "exact_match": S.with_(S.PAIRS) + f"""SELECT request_id,
        (regexp_extract_all(lower(response), '{S.WORD}')
          = regexp_extract_all(lower(expected_response), '{S.WORD}'))::INTEGER AS exact_match
        FROM pairs""",
    "lexical_relevance": S.with_(S.PAIRS, _D, _TOKENS, _REL)
    + "SELECT request_id, round(relevance, 6) AS relevance FROM rel",
    "context_support": S.with_(S.PAIRS, _TOKENS, _SUP)
    + "SELECT request_id, round(support, 6) AS support FROM sup",
    "tier_rule": S.with_(S.CUST) + f"""SELECT l_orderkey, l_linenumber, tier, response,
        {_TIER} AS score FROM (SELECT *, {_PERCENT.format(c='response')} AS p FROM (
          SELECT l_orderkey, l_linenumber, tier, CASE WHEN l_returnflag = 'N' THEN 'no discount'
            ELSE round(l_discount * 100)::INTEGER || '% off, fee '
              || round(l_tax * 100)::INTEGER || '%' END AS response
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey
          JOIN cust ON customer_id = 'C' || lpad(o_custkey::VARCHAR, 9, '0')))""",
    "safety_rule": S.with_(S.PAIRS) + f"SELECT request_id, {_safety(WORDS)} AS score FROM pairs",
    "judge_prompt": S.with_(S.PAIRS) + "SELECT request_id, '%s' AS metric, '%s' || %s AS prompt FROM pairs" % (
        _JUDGE.name,
        (_JUDGE.definition + "\n\n" + "".join(
            f"question: {e.question}\nresponse: {e.response}\nscore: {e.score}\n{e.why}\n\n"
            for e in _JUDGE.examples
        )).replace("'", "''"),
        "'" + _JUDGE.template.replace("'", "''")
        .replace("{question}", "' || question || '")
        .replace("{ground_truth}", "' || expected_response || '")
        .replace("{prediction}", "' || response || '") + "'",
    ),
    "score_check": """SELECT doc_id, metric, score, CASE WHEN doc_id % 4 = 1 THEN 'unexpected'
        WHEN score IS NULL THEN 'missing' WHEN doc_id % 10 = 3 THEN 'duplicate'
        WHEN score NOT BETWEEN 1 AND 5 THEN 'out_of_range' ELSE 'ok' END AS status FROM (
          SELECT doc_id, 'quality' AS metric, (1.0 + 5 * quality)::DOUBLE AS score
            FROM documents LEFT JOIN labels USING (doc_id)
          UNION ALL SELECT doc_id, 'safety', (5.0 - 4 * toxic)::DOUBLE
            FROM documents LEFT JOIN labels USING (doc_id))
        WHERE doc_id % 4 <> 1 OR score IS NOT NULL""",
    "answer_rows": S.with_(
        S.REQ, _D, S.ranked("s", "d", "req", "request_id"), S.best("b", "s", 1)
    ) + """SELECT q AS request_id, text AS answer, CASE WHEN contains(text, 'eau')
        THEN 'エラー: cannot read this' ELSE length(text) || ': ' || text END AS response
        FROM b JOIN documents ON doc_id = id""",
    "evaluate_summary": S.with_(
        S.CUST, S.PAIRS, _D, _TOKENS, _F1, _REL, _SUP,
        f"""m AS (SELECT request_id, ({_TIER})::DOUBLE AS tier_percentages,
          ({_safety({"safety": C.SAFETY_WORDS, "defer": C.DEFER_WORDS, "urgent": C.URGENT_WORDS,
                     "action": C.ACTION_WORDS})})::DOUBLE AS safety_words,
          1.0 + 4 * (regexp_extract_all(lower(response), '{S.WORD}')
            = regexp_extract_all(lower(expected_response), '{S.WORD}'))::INTEGER AS exact_match
          FROM (SELECT *, {_PERCENT.format(c='response')} AS p
            FROM pairs LEFT JOIN cust USING (customer_id)))""",
        _LONG,
    ) + """SELECT metric, round(avg(score), 4) AS mean_score, count(score) AS n_scores
        FROM long GROUP BY 1""",
}
