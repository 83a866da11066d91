"""Evaluation: flattening, lexical measures, judge tables, summaries and reports.

The lexical measures are transparent stand-ins with names of their own; they do not measure
what a language model judges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hibiki import constants as C
from hibiki.functions.scores import low_line, score_bar, summary_line, valid_score
from hibiki.functions.text import fill_template, or_empty, shorten, tokens
from hibiki.operators.conversation import first_content
from hibiki.operators.text_index import TextIndex, with_idf

DIGITS = 6


# --- the evaluation set -------------------------------------------------------------------

def flatten_eval(items: DataFrame) -> DataFrame:
    """(request json, expected_response, ground_truth_context, question) per item.

    Missing texts become empty; other columns, such as an id, are kept.
    """
    own = ("request", "expected_response", "ground_truth_context")
    return items.select(
        *[c for c in items.columns if c not in own],
        F.to_json("request", {"ignoreNullFields": "false"}).alias("request"),
        or_empty(F.col("expected_response")).alias("expected_response"),
        or_empty(F.col("ground_truth_context")).alias("ground_truth_context"),
        first_content(F.col("request.messages")).alias("question"),
    )


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Metric inputs under their own names, e.g. {"inputs": "question"}."""
    return df.withColumnsRenamed({source: name for name, source in mapping.items()})


def align(answers: DataFrame, expected: DataFrame, key: str = "request_id") -> DataFrame:
    """Answers beside what was expected; requests without an answer stay, with a null."""
    return expected.join(answers, key, "left")


# --- lexical measures -----------------------------------------------------------------------

def token_counts(rows: DataFrame, key: str, texts: dict[str, Column]) -> DataFrame:
    """How often each token occurs in each text of a row: (key, token, one column per text).

    The texts of a row are counted together, so measures share one shuffle. A row without any
    token keeps one line, with a null.
    """
    def marked(name: str, text: Column) -> Column:
        return F.transform(
            tokens(text), lambda t: F.struct(F.lit(name).alias("part"), t.alias("token"))
        )

    # The texts are shuffled by key once, before they fall apart into tokens: counting by
    # (key, token) and then by key happens where they lie.
    placed = rows.select(key, *[text.alias(name) for name, text in texts.items()]).repartition(key)
    parts = [marked(name, F.col(name)) for name in texts]
    counted = placed.select(key, F.explode_outer(F.concat(*parts)).alias("t")).groupBy(
        key, F.col("t.token").alias("token")
    )
    return counted.agg(
        *[F.count_if(F.col("t.part") == name).alias(name) for name in texts]
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), DIGITS)


def _overlap() -> dict[str, Column]:
    same, r, e = F.sum(F.least("r", "e")), F.sum("r"), F.sum("e")
    return {
        "precision": _ratio(same, r), "recall": _ratio(same, e), "f1": _ratio(2 * same, r + e)
    }


def _cosine() -> Column:
    square = F.col("idf") * F.col("idf")

    def dot(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.col(b) * square)

    return _ratio(dot("q", "r"), F.sqrt(dot("q", "q")) * F.sqrt(dot("r", "r")))


def _support() -> Column:
    return _ratio(F.sum(F.when(F.col("c") > 0, F.col("r")).otherwise(0)), F.sum("r"))


def _with_idf(counts: DataFrame, index: TextIndex) -> DataFrame:
    unseen = F.lit(1.0) + F.log(F.lit(float(index.n_docs + 1)))
    return with_idf(counts, index.vocab, unseen)


def token_f1(rows: DataFrame, key: str, response: str, expected: str) -> DataFrame:
    """Overlap of tokens, each counted as often as both texts have it:
    (key, precision, recall, f1). The key must be unique."""
    counts = token_counts(rows, key, {"r": F.col(response), "e": F.col(expected)})
    return counts.groupBy(key).agg(*[c.alias(n) for n, c in _overlap().items()])


def exact_match(response: Column, expected: Column) -> Column:
    """Whether the texts have the same tokens in the same order."""
    return (tokens(response) == tokens(expected)).cast("int")


def lexical_relevance(
    rows: DataFrame, key: str, question: str, response: str, index: TextIndex
) -> DataFrame:
    """TF-IDF cosine of question and response, with the rarity of the index: (key, relevance)."""
    counts = token_counts(rows, key, {"q": F.col(question), "r": F.col(response)})
    return _with_idf(counts, index).groupBy(key).agg(_cosine().alias("relevance"))


def context_support(rows: DataFrame, key: str, response: str, context: str) -> DataFrame:
    """Share of the response's tokens that the context has too: (key, support)."""
    counts = token_counts(rows, key, {"r": F.col(response), "c": F.col(context)})
    return counts.groupBy(key).agg(_support().alias("support"))


def lexical_measures(
    rows: DataFrame, key: str, question: str, response: str, expected: str, context: str,
    index: TextIndex,
) -> DataFrame:
    """All of the above from one count: (key, precision, recall, f1, relevance, support)."""
    counts = token_counts(
        rows, key,
        {"q": F.col(question), "r": F.col(response), "e": F.col(expected), "c": F.col(context)},
    )
    return _with_idf(counts, index).groupBy(key).agg(
        *[c.alias(n) for n, c in _overlap().items()],
        _cosine().alias("relevance"),
        _support().alias("support"),
    )


# --- metrics and judges ---------------------------------------------------------------------

@dataclass(frozen=True)
class Example:
    """A scored example shown to a judge."""

    question: str
    response: str
    score: int
    why: str = ""


@dataclass(frozen=True)
class Metric:
    """A measure per row: a rule as a Column, and what a judge needs to score it instead."""

    name: str
    definition: str = ""
    template: str = ""
    examples: Sequence[Example] = field(default_factory=tuple)
    greater_is_better: bool = True
    rule: Callable[[], Column] | None = None

    @property
    def score_column(self) -> str:
        return f"{self.name}/score"


class MetricRegistry:
    """Metrics by name."""

    def __init__(self, metrics: Sequence[Metric] = ()):
        self._metrics: dict[str, Metric] = {}
        for metric in metrics:
            self.add(metric)

    def add(self, metric: Metric) -> None:
        if metric.name in self._metrics:
            raise ValueError(f"metric {metric.name} exists already")
        self._metrics[metric.name] = metric

    def __getitem__(self, name: str) -> Metric:
        return self._metrics[name]

    def __iter__(self):
        return iter(self._metrics.values())

    def score(self, rows: DataFrame) -> DataFrame:
        """Add one ``<name>/score`` column per metric that has a rule."""
        return rows.withColumns(
            {m.score_column: m.rule().cast("double") for m in self if m.rule is not None}
        )


def judge_prompts(
    rows: DataFrame, metric: Metric, key: str, question: str, response: str, expected: str
) -> DataFrame:
    """One prompt per row for a judge of your choice: (key, metric, prompt)."""
    shown = "".join(
        f"question: {e.question}\nresponse: {e.response}\nscore: {e.score}\n{e.why}\n\n"
        for e in metric.examples
    )
    prompt = F.concat(
        F.lit(f"{metric.definition}\n\n{shown}"),
        fill_template(
            metric.template,
            {
                "question": F.col(question),
                "ground_truth": F.col(expected),
                "prediction": F.col(response),
            },
        ),
    )
    return rows.select(key, F.lit(metric.name).alias("metric"), prompt.alias("prompt"))


def take_scores(
    expected: DataFrame, scores: DataFrame, key: str = "request_id"
) -> DataFrame:
    """Scores that judges sent back, one row per pair, with a status.

    ``expected`` holds the (key, metric) pairs sent out. Keep the ``ok`` ones; the others are
    the reject table: ``missing``, ``out_of_range``, ``unexpected`` (nobody asked for the pair) and
    ``duplicate`` (several scores came for it; the lowest is shown).
    """
    sent = expected.select(key, "metric").distinct().withColumn("_sent", F.lit(True))
    back = scores.groupBy(key, "metric").agg(
        F.min(F.col("score").cast("double")).alias("score"), F.count(F.lit(1)).alias("_n")
    )
    return (
        sent.join(back, [key, "metric"], "full")
        .select(
            key, "metric", "score",
            F.when(F.col("_sent").isNull(), "unexpected")
            .when(F.col("_n") > 1, "duplicate")
            .when(F.col("score").isNull() | F.isnan("score"), "missing")
            .when(~valid_score(F.col("score")), "out_of_range")
            .otherwise("ok").alias("status"),
        )
    )


# --- summaries and reports --------------------------------------------------------------------

def score_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "/score" in c]


def display_columns(df: DataFrame, first: Sequence[str] = ("question", "response")) -> list[str]:
    """The given columns, as far as they exist, and all score columns."""
    return [c for c in [*first, *score_columns(df)] if c in df.columns]


def select_quoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select by name, with names that hold slashes or dots."""
    return df.select(*[f"`{c}`" for c in columns])


def long_scores(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids, metric, score), one row per score column."""
    scores = score_columns(wide)
    return wide.select(
        *ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in scores]
    ).unpivot(list(ids), [F.col(f"`{c}`") for c in scores], "metric", "score")


def low_scores(long: DataFrame, limit: float = C.LOW_SCORE) -> DataFrame:
    """Scores below the limit; null and NaN are not below."""
    return long.filter((F.col("score") < limit) & ~F.isnan("score"))


def low_counts(long: DataFrame, limit: float = C.LOW_SCORE) -> DataFrame:
    """How many low scores per metric, for the metrics that have any."""
    return low_scores(long, limit).groupBy("metric").agg(F.count("*").alias("n_low"))


def metric_summary(long: DataFrame) -> DataFrame:
    """Mean and number of scores per metric; null and NaN count for neither."""
    score = F.when(~F.isnan("score"), F.col("score"))
    return long.groupBy("metric").agg(
        F.avg(score).alias("mean_score"), F.count(score).alias("n_scores")
    )


def summary_lines(summary: DataFrame) -> DataFrame:
    """The printed summary: (metric, bar, line)."""
    mean = F.col("mean_score")
    return summary.filter("mean_score is not null").select(
        "metric", score_bar(mean).alias("bar"), summary_line(F.col("metric"), mean).alias("line")
    )


def low_report(long: DataFrame, question: str = "question", length: int = 80) -> DataFrame:
    """The printed list of low scores: (metric, question cut short, line)."""
    low = low_scores(long)
    return low.select(
        "metric",
        shorten(F.col(question), length).alias("question"),
        low_line(F.col(question), F.col("score")).alias("line"),
    )
