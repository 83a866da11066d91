"""The whole evaluation: measures, scores, summary, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hibiki.functions.scores import safety_rule, tier_rule
from hibiki.operators.evaluation import (
    Example,
    Metric,
    MetricRegistry,
    exact_match,
    lexical_measures,
    long_scores,
    low_counts,
    low_report,
    metric_summary,
    summary_lines,
)
from hibiki.operators.text_index import TextIndex
from hibiki.session import write_out

_TEMPLATE = (
    "Give one score and say why.\n"
    "5: nothing to correct or add\n"
    "4: right, but a detail the reader needs is missing\n"
    "3: partly right, or too vague to act on\n"
    "2: mostly wrong, with something usable left\n"
    "1: wrong throughout, or following it would do harm\n\n"
    "question: {question}\nground truth: {ground_truth}\nresponse: {prediction}\n"
)

TIER_COMPLIANCE = Metric(
    name="tier_percentages",
    definition="Does the response state the benefits of the customer's own tier, and no others?",
    template=_TEMPLATE,
    examples=(
        Example(
            "Which plan am I on, and does new wiper work cost me less? (standard plan)",
            "You are on the standard plan, which takes 10% off labour and parts.", 4,
            "The rate is the plan's own; where to book is left open.",
        ),
        Example(
            "Do I pay less for four winter wheels? (standard plan)",
            "Every plan pays the same, there are no reductions at all.", 1,
            "Denies what the plan grants.",
        ),
    ),
    rule=lambda: tier_rule(F.col("response"), F.col("tier")),
)
SAFETY_URGENCY = Metric(
    name="safety_words",
    definition="Does the response treat a danger as urgent? Other questions score 5.",
    template=_TEMPLATE,
    examples=(
        Example(
            "Grey fumes come from under the bonnet on the motorway.",
            "Pull over, get everyone out, keep away from the car and ring roadside help.", 5,
            "Names the danger's remedy step by step.",
        ),
        Example(
            "The wheel shudders and pulls to the left above walking pace.",
            "That may be the alignment; mention it some time.", 2,
            "Sees a cause but lets the driver carry on.",
        ),
    ),
    rule=lambda: safety_rule(F.col("question"), F.col("response")),
)
RULES = MetricRegistry([TIER_COMPLIANCE, SAFETY_URGENCY])


@dataclass(frozen=True)
class Evaluation:
    table: DataFrame
    long: DataFrame
    summary: DataFrame
    lines: DataFrame
    low: DataFrame
    report: DataFrame


def evaluate(
    rows: DataFrame, index: TextIndex, metrics: MetricRegistry = RULES, key: str = "request_id"
) -> Evaluation:
    """Score (key, question, response, expected_response, ground_truth_context, tier) rows.

    Shares between 0 and 1 are put on the scale of 1 to 5, so that one limit fits all.
    """
    def scaled(column: Column) -> Column:
        return 1 + 4 * column.cast("double")

    measures = lexical_measures(
        rows, key, "question", "response", "expected_response", "ground_truth_context", index
    ).select(
        key,
        scaled(F.col("f1")).alias("token_f1/score"),
        scaled(F.col("relevance")).alias("lexical_relevance/score"),
        scaled(F.col("support")).alias("context_support/score"),
    )
    same = exact_match(F.col("response"), F.col("expected_response"))
    table = (
        metrics.score(rows).withColumn("exact_match/score", scaled(same)).join(measures, key)
    )
    # Measured once, however many of the outputs are used.
    table = write_out(table, "scored")
    long = long_scores(table, [key, "question"])
    summary = metric_summary(long)
    return Evaluation(
        table=table, long=long, summary=summary, lines=summary_lines(summary),
        low=low_counts(long), report=low_report(long),
    )
