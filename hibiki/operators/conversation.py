"""Messages of a request, as an array per request or as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hibiki.functions.text import final_answer


def first_content(messages: Column) -> Column:
    """The content of the first message of an array, null if there is none."""
    return F.get(messages, F.lit(0))["content"]


def with_system_prompt(messages: Column, prompt: str) -> Column:
    """The system prompt, then the messages as they came, whatever their role."""
    system = F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content"))
    return F.concat(F.array(system), F.coalesce(messages, F.array()))


def assemble_messages(
    turns: DataFrame, prompt: str, key: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """The same for messages that are rows: (key, position, role, content).

    The prompt takes position 0 and every turn moves up by one; nothing is gathered per
    conversation, however long it is.
    """
    system = turns.select(key).distinct().select(
        key, F.lit(0).cast("long").alias("position"), F.lit("system").alias("role"),
        F.lit(prompt).alias("content"),
    )
    return system.unionByName(
        turns.select(
            key, (F.col(turn) + 1).cast("long").alias("position"), "role",
            F.col(text).alias("content"),
        )
    )


def final_answers(answers: DataFrame, content: str = "content") -> DataFrame:
    """Replace missing answers by the fixed apology."""
    return answers.withColumn(content, final_answer(F.col(content)))


def feedback_counts(feedback: DataFrame, day: str, is_up: Column, is_down: Column) -> DataFrame:
    """Thumbs up and down per day."""
    return feedback.groupBy(day).agg(
        F.count_if(is_up).alias("up"), F.count_if(is_down).alias("down")
    )


