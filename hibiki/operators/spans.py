"""Spans of a trace: one per request, with its calls below it.

A request is what one requester's calls make up until none follows for some time. The request's span
lasts from its first call to its last, a call's span until the next call of its request (the last
call's has no length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUEST, CALL = "chain", "tool"


def _seconds(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def request_spans(
    calls: DataFrame, gap_seconds: int, key: str = "request_id", call: str = "call_id", name: str = "name",
    time: str = "ts", kind: Column | None = None,
) -> DataFrame:
    """(trace_id, span_id, parent_id, name, span_type, started, micros) of all requests and calls.

    ``trace_id`` is the requester's key with the start of the request. Calls at the same time follow
    each other in the order of their ids. Calls without a time or key have no span.
    """
    own = Window.partitionBy("key").orderBy("ts", "call")
    rows = calls.select(
        F.col(key).alias("key"), F.col(call).alias("call"), F.col(name).alias("name"), F.col(time).alias("ts"),
        (F.lit(CALL) if kind is None else kind).alias("span_type"),
    ).dropna(subset=["key", "ts"])
    before = F.lag("ts").over(own)
    first = before.isNull() | (_seconds(before, F.col("ts")) > gap_seconds * 1_000_000)
    # The time of the newest first call so far names the request; no second shuffle is needed.
    rows = rows.withColumn("begin", F.when(first, F.col("ts"))).withColumn(
        "begin", F.last("begin", ignorenulls=True).over(own)
    )
    request = Window.partitionBy("key", "begin").orderBy("ts", "call")
    following = F.lead("ts").over(request)
    stamp = F.date_format("begin", "yyyyMMddHHmmss")
    rows = rows.withColumn("micros", F.coalesce(_seconds(F.col("ts"), following), F.lit(0).cast("long"))).withColumn(
        "trace_id", F.concat_ws("-", F.col("key").cast("string"), stamp)
    )
    spans = rows.select(
        "trace_id", F.col("call").cast("string").alias("span_id"), F.col("trace_id").alias("parent_id"), "name",
        "span_type", F.col("ts").alias("started"), "micros",
    )
    roots = rows.groupBy("key", "begin", "trace_id").agg(F.sum("micros").alias("micros")).select(
        "trace_id", F.col("trace_id").alias("span_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit("request").alias("name"), F.lit(REQUEST).alias("span_type"), F.col("begin").alias("started"), "micros",
    )
    return roots.unionByName(spans)


def closed_requests(calls: DataFrame, gap: str, late: str, key: str = "request_id", time: str = "ts") -> DataFrame:
    """Requests of a stream: (key, started, ended, calls), each given out once, when it is closed.

    A request closes when the stream's time has passed its last call by ``gap`` and ``late``; calls
    that come up to ``late`` after their time are counted, and may join two requests into one. State
    is one row per open request.
    """
    return (
        calls.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("session"), F.col(key))
        .agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("calls"))
        .select(key, "started", "ended", "calls")
    )
