import math

import pytest
from pyspark.sql import functions as F

from hibiki import constants as C
from hibiki import schemas
from hibiki.operators import evaluation as E
from hibiki.operators.answers import answer_from_passage, apply_answers
from hibiki.operators.conversation import (
    assemble_messages,
    feedback_counts,
    final_answers,
    first_content,
    with_system_prompt,
)
from hibiki.operators.text_index import build_text_index
from hibiki.plans.evaluate import RULES, evaluate
from hibiki.session import new_path

from conftest import rows


def test_flatten(spark):
    items = spark.createDataFrame(
        [(([{"role": "user", "content": "問"}],), "答", None), (([],), None, "文脈"), (None, None, None)],
        schemas.EVAL_DATASET,
    )
    got = E.flatten_eval(items).collect()
    assert got[0].request == '{"messages":[{"role":"user","content":"問"}]}'
    assert [(r.expected_response, r.ground_truth_context, r.question) for r in got] == [
        ("答", "", "問"), ("", "文脈", None), ("", "", None),
    ]


def test_align_and_rename(spark):
    expected = spark.createDataFrame([(1, "q"), (2, "q")], "request_id int, question string")
    answers = spark.createDataFrame([(1, "a")], "request_id int, response string")
    got = E.align(answers, E.rename_columns(expected, {"inputs": "question"}))
    assert rows(got.select("request_id", "inputs", "response"), "request_id") == [
        (1, "q", "a"), (2, "q", None),
    ]


PAIRS = [
    (1, "oil change", "change the oil the oil", "change the oil", "oil oil"),
    (2, "", "", "", ""),
    (3, "a", "b", "c", "d"),
    (4, "油の交換", "油の交換", "油の交換", "油の交換は半年"),
    (5, None, None, "x", None),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(
        PAIRS, "request_id int, question string, response string, expected_response string, "
        "ground_truth_context string"
    )


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(1, "oil change"), (2, "油の交換")], "id int, text string")
    return build_text_index(docs, new_path(spark, "e"))


def test_token_f1(pairs):
    got = rows(E.token_f1(pairs, "request_id", "response", "expected_response"), "request_id")
    assert got[0] == (1, 0.6, 1.0, 0.75)
    assert got[1][1:] == got[2][1:] == got[4][1:] == (0.0, 0.0, 0.0)
    assert got[3][1:] == (1.0, 1.0, 1.0)


def test_support_relevance_and_exact_match(pairs, index):
    support = rows(E.context_support(pairs, "request_id", "response", "ground_truth_context"),
                   "request_id")
    assert [x for _, x in support] == [0.4, 0.0, 0.0, 1.0, 0.0]
    relevance = dict(rows(E.lexical_relevance(pairs, "request_id", "question", "response", index),
                          "request_id"))
    assert relevance[4] == 1.0 and relevance[3] == 0.0 and 0 < relevance[1] < 1
    exact = pairs.select("request_id", E.exact_match(F.col("response"), F.col("expected_response")))
    assert [x for _, x in rows(exact, "request_id")] == [0, 1, 0, 1, 0]


def test_measures_together_equal_measures_apart(pairs, index):
    together = E.lexical_measures(pairs, "request_id", "question", "response",
                                  "expected_response", "ground_truth_context", index)
    apart = (
        E.token_f1(pairs, "request_id", "response", "expected_response")
        .join(E.lexical_relevance(pairs, "request_id", "question", "response", index), "request_id")
        .join(E.context_support(pairs, "request_id", "response", "ground_truth_context"),
              "request_id")
    )
    assert rows(together, "request_id") == rows(apart, "request_id")


def scores(spark):
    nan = float("nan")
    return spark.createDataFrame(
        [(1, "q1", 3.5, 2.0), (2, "q" * 90, 3.4, None), (3, "q3", nan, 5.0)],
        "id int, question string, `a/score` double, `b/v1/score` double",
    )


def test_reports(spark):
    wide = scores(spark).withColumn("other", F.lit(1))
    assert E.display_columns(wide) == ["question", "a/score", "b/v1/score"]
    assert E.select_quoted(wide, E.display_columns(wide)).columns == E.display_columns(wide)
    long = E.long_scores(wide, ["id", "question"])
    assert long.count() == 6
    low = rows(E.low_scores(long).select("id", "metric", "score"), "id")
    assert low == [(1, "b/v1/score", 2.0), (2, "a/score", 3.4)]
    assert rows(E.low_counts(long), "metric") == [("a/score", 1), ("b/v1/score", 1)]
    assert rows(E.low_counts(long, 1.0), "metric") == []
    summary = E.metric_summary(long)
    assert rows(summary, "metric") == [("a/score", 3.45, 2), ("b/v1/score", 3.5, 2)]
    lines = {r.metric: r.line for r in E.summary_lines(summary).collect()}
    assert lines["a/score"] == f"  {'a/score':<45}: ███░░ 3.45/5.00"
    report = {r.metric: r for r in E.low_report(long).collect()}
    assert report["a/score"].question == "q" * 80 + "..."
    assert report["b/v1/score"].line == "  質問: q1... | スコア: 2.0"


def test_scores_from_judges(spark):
    expected = spark.createDataFrame(
        [(1, "m"), (2, "m"), (3, "m"), (4, "m"), (5, "m")], "request_id int, metric string"
    )
    back = spark.createDataFrame(
        [(1, "m", 5.0), (2, "m", 5.1), (3, "m", float("nan")), (5, "other", 1.0)],
        "request_id int, metric string, score double",
    )
    got = {(r.request_id, r.metric): r.status for r in E.take_scores(expected, back).collect()}
    more = back.unionByName(back.filter("request_id = 1")).unionByName(
        back.limit(1).withColumn("request_id", F.lit(77)))
    again = E.take_scores(expected, more).filter("request_id IN (1, 77)").collect()
    assert {r.request_id: r.status for r in again} == {1: "duplicate", 77: "unexpected"}
    assert got == {
        (1, "m"): "ok", (2, "m"): "out_of_range", (3, "m"): "missing", (4, "m"): "missing",
        (5, "m"): "missing", (5, "other"): "unexpected",
    }


def test_registry_and_prompts(spark, pairs):
    assert [m.name for m in RULES] == ["tier_percentages", "safety_words"]
    with pytest.raises(ValueError):
        RULES.add(RULES["safety_words"])
    prompts = E.judge_prompts(pairs, RULES["safety_words"], "request_id", "question", "response",
                              "expected_response")
    first = prompts.filter("request_id = 1").first()
    assert "question: oil change" in first.prompt and "{prediction}" not in first.prompt
    assert prompts.filter("prompt is null").count() == 0


def test_evaluate(spark, pairs, index):
    done = evaluate(pairs.withColumn("tier", F.lit("gold")), index)
    table = {r.request_id: r for r in done.table.collect()}
    assert len(table) == 5
    assert table[4]["token_f1/score"] == 5.0 and table[4]["exact_match/score"] == 5.0
    assert table[1]["tier_percentages/score"] == 3.0 and table[1]["safety_words/score"] == 5.0
    assert done.summary.count() == 6 and done.lines.count() == 6
    counted = {r.metric: r.n_low for r in done.low.collect()}
    assert counted["tier_percentages/score"] == 5
    assert done.report.count() == sum(counted.values())


def test_answers_of_a_failing_function(spark):
    def answer(texts):
        if "bad" in texts:
            raise ValueError("no " + "answer")
        return [t.upper() for t in texts]

    asked = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, request string")
    got = rows(apply_answers(asked, answer, workers=2), "id")
    assert got == [(1, "a", "A"), (2, "bad", "エラー: no answer"), (3, "c", "C")]
    short = apply_answers(asked, lambda texts: ["one"] if len(texts) == 1 else [])
    assert {r.response for r in short.collect()} == {"one"}
    assert apply_answers(asked, answer, workers=C.ANSWER_WORKERS).rdd.getNumPartitions() == 4


def test_offline_answer_and_fallback(spark):
    df = spark.createDataFrame([("q", "p"), ("q", None)], "q string, p string")
    got = df.select(answer_from_passage(F.col("q"), F.col("p")).alias("content"))
    assert {r.content for r in final_answers(got).collect()} == {"q\np", C.ANSWER_FALLBACK}


def test_messages(spark):
    df = spark.createDataFrame(
        [([("system", "s"), ("user", "u")],), ([],), (None,)],
        "messages array<struct<role: string, content: string>>",
    )
    got = df.select(
        with_system_prompt(F.col("messages"), "P").alias("m"),
        first_content(F.col("messages")).alias("first"),
    ).collect()
    assert [[m.content for m in r.m] for r in got] == [["P", "s", "u"], ["P"], ["P"]]
    assert [r.first for r in got] == ["s", None, None]
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "c")],
        "conv_id int, turn int, role string, text string",
    )
    assert rows(assemble_messages(turns, "P"), "conv_id", "position") == [
        (1, 0, "system", "P"), (1, 1, "user", "a"), (1, 2, "assistant", "b"),
        (2, 0, "system", "P"), (2, 1, "system", "c"),
    ]


def test_feedback(spark):
    df = spark.createDataFrame([("d1", "up"), ("d1", "down"), ("d1", None), ("d2", "up")],
                               "day string, thumb string")
    got = feedback_counts(df, "day", F.col("thumb") == "up", F.col("thumb") == "down")
    assert rows(got, "day") == [("d1", 1, 1), ("d2", 1, 0)]
    assert math.isclose(sum(r.up for r in got.collect()), 2)
