"""Spans, the online copy, split JSON arrays, the answer ledger, counted loads, stored days."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki.operators import answers as A
from hibiki.operators import vector_table as VT
from hibiki.operators.ranking import latest_per_key
from hibiki.operators.spans import closed_requests, request_spans
from hibiki.operators.vector_search import vector_topk
from hibiki.plans import online as O
from hibiki.session import new_path
from hibiki.sources.json_arrays import read_json_array, write_json_array
from hibiki.sources.landing import counted, observed_counts
from hibiki.streaming.jobs import read_files

from conftest import rows


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 9 + minute // 60, minute % 60, second)


# -- spans ------------------------------------------------------------------------------------------


def test_requests_end_where_nothing_follows(spark):
    calls = [("a", 1, "x", at(0)), ("a", 2, "y", at(3)), ("a", 3, "x", at(13, 1)), ("b", 4, "x", at(5)),
             ("a", 6, "z", at(3)), (None, 7, "x", at(1)), ("b", 8, "x", None)]
    table = spark.createDataFrame(calls, "request_id string, call_id long, name string, ts timestamp")
    spans = request_spans(table, 600).collect()
    roots = {r.trace_id: (r.started, r.micros) for r in spans if r.parent_id is None}
    assert roots == {"a-20240101090000": (at(0), 180_000_000), "a-20240101091301": (at(13, 1), 0),
                     "b-20240101090500": (at(5), 0)}
    below = {r.span_id: (r.parent_id, r.micros) for r in spans if r.parent_id is not None}
    assert below["1"] == ("a-20240101090000", 180_000_000) and below["2"][1] == below["6"][1] == 0
    assert set(below) == {"1", "2", "3", "4", "6"}


def test_a_late_call_is_counted_before_its_request_closes(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "request_id string, ts timestamp"

    def run(name, *calls):
        spark.createDataFrame(list(calls), schema).coalesce(1).write.parquet(f"{folder}/{name}")
        stream = closed_requests(read_files(spark, f"{folder}/*", schema), "10 minutes", "30 minutes")
        stream.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "progress")
        ).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.schema("request_id string, started timestamp, ended timestamp, calls long")
                    .parquet(out), "request_id", "started")

    assert run("a", ("a", at(0)), ("a", at(5)), ("b", at(1)), ("b", at(18))) == []
    assert run("b", ("b", at(9)), ("c", at(20))) == []  # joins the two calls of b into one request
    closed = run("c", ("d", at(120)))
    assert closed == [("a", at(0), at(5), 2), ("b", at(1), at(18), 3), ("c", at(20), at(20), 1)]
    assert run("d", ("d", at(121))) == closed  # given out once


# -- the online copy --------------------------------------------------------------------------------


def test_the_copy_follows_its_feeds_whatever_their_order(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 10)
    rng, path = random.Random(2), new_path(spark, "online")
    changes = [(rng.randrange(40), v, f"v{v}", v % 7 == 0) for v in range(120)]
    schema = "id int, version int, value string, gone boolean"
    table = lambda part: spark.createDataFrame(part, schema)
    parts = [changes[:70], changes[70:90], changes[90:]]
    written = [O.sync_online(table(parts[i]), path, ["id"], "version", F.col("gone")) for i in (0, 2, 1, 2)]
    wanted = rows(latest_per_key(table(changes), ["id"], [F.desc("version")]).filter("not gone"), "id")
    got = O.read_online(spark, path).select("id", "version", "value", "gone")
    assert rows(got, "id") == wanted
    assert len(written[0]) > 4 and O.sync_online(table(changes[:1]), path, ["id"], "version", F.col("gone")) != written[0]
    one = O.look_up(spark, path, ["id"], [wanted[0][0]])
    assert rows(one.select("id", "version", "value", "gone"), "id") == wanted[:1]
    assert O.look_up(spark, path, ["id"], [-1]).isEmpty()
    assert O.sync_online(table([]), path, ["id"], "version") == []


def test_only_touched_buckets_are_written_and_a_failed_refresh_leaves_the_copy(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 5)
    path, schema = new_path(spark, "online"), "id int, version int"
    O.sync_online(spark.createDataFrame([(i, 1) for i in range(50)], schema), path, ["id"], "version")
    before = O._last(spark, path).folders
    touched = O.sync_online(spark.createDataFrame([(3, 2)], schema), path, ["id"], "version")
    after = O._last(spark, path).folders
    assert len(touched) == 1 and [a == b for a, b in zip(before, after)].count(False) == 1
    opened = O.read_online(spark, path)
    with monkeypatch.context() as patch:
        patch.setattr(O, "latest_per_key", lambda *a: (_ for _ in ()).throw(RuntimeError))
        with pytest.raises(RuntimeError):
            O.sync_online(spark.createDataFrame([(4, 9)], schema), path, ["id"], "version")
    assert rows(O.read_online(spark, path), "id") == rows(opened, "id")
    assert rows(opened.filter("id = 3").select("version"), "version") == [(2,)]


# -- JSON arrays ------------------------------------------------------------------------------------

ODD_TEXTS = ['a "quoted" {brace}', "back\\slash", 'ends with \\', '\\"}{', "}\n{", "", None, "日本語 {}", '"', "[1, {", "x" * 5000]
JSON = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()),
                     T.StructField("more", T.StructType([T.StructField("list", T.ArrayType(T.StringType()))]))])


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_is_read_by_many_tasks(spark, tmp_path, indent):
    rng = random.Random(4)
    docs = [{"id": i, "text": rng.choice(ODD_TEXTS), "more": {"list": rng.choices(["}", "{\"", "a"], k=i % 3)}}
            for i in range(700)]
    path = tmp_path / "docs.json"
    path.write_text(json.dumps(docs, indent=indent, ensure_ascii=False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 5
        got = Counter(map(str, read_json_array(spark, str(path), JSON).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == Counter(map(str, spark.read.schema(JSON).option("multiLine", True).json(str(path)).collect()))
    assert sum(got.values()) == 700


def test_arrays_of_several_files_and_empty_ones(spark, tmp_path):
    for i, text in enumerate(["[]", " [ ]\n", '[{"id": 1}]', '[\n{"id": 2, "text": "}"} , {"id": 3}\n]']):
        (tmp_path / f"{i}.json").write_text(text)
    got = read_json_array(spark, str(tmp_path), JSON)
    assert rows(got.select("id", "text"), "id") == [(1, None), (2, "}"), (3, None)]
    folder = new_path(spark, "arrays")
    write_json_array(spark.createDataFrame([(i, t, None) for i, t in enumerate(ODD_TEXTS)], JSON), folder)
    assert rows(read_json_array(spark, folder, JSON).select("id", "text"), "id") == list(enumerate(ODD_TEXTS))


# -- the answer ledger ------------------------------------------------------------------------------


def test_each_text_is_asked_once(spark, tmp_path, monkeypatch):
    calls = str(tmp_path / "calls")

    def answer(text):
        with open(calls, "a") as log:
            log.write(f"{text}\n")
        if text == "bad":
            raise ValueError("no")
        return f"re {text}"

    asked = [(i, f"t{i % 20}") for i in range(60)] + [(99, "bad"), (100, None)]
    table = spark.createDataFrame(asked, "request_id int, request string")
    path, pmod, chunks = new_path(spark, "ledger"), F.pmod, []

    class Lost(Exception):
        pass

    def lost_at_the_fourth(*a):
        chunks.append(a)
        if len(chunks) == 4:
            raise Lost
        return pmod(*a)

    # The job dies while chunks are being asked for; what is done stays.
    with monkeypatch.context() as patch:
        patch.setattr(A.F, "pmod", lost_at_the_fourth)
        with pytest.raises(Lost):
            A.answer_ledger(table, answer, path, chunk_rows=4, workers=1)
    first = open(calls).read().split("\n")[:-1]
    assert 0 < len(first) < 22
    got = A.answer_ledger(table, answer, path, chunk_rows=4, workers=2)
    wanted = [(i, t, "エラー: no" if t == "bad" else f"re {t}") for i, t in asked]
    assert rows(got, "request_id") == wanted
    A.answer_ledger(table, answer, path)
    assert all(n == 1 for n in Counter(open(calls).read().split("\n")[:-1]).values())
    fixed = A.answer_ledger(table, lambda t: f"at last {t}", path, again=True)
    assert rows(fixed.filter("request_id IN (1, 99)").select("response"), "response") == [("at last bad",), ("re t1",)]
    assert A.answer_ledger(table.limit(0), answer, new_path(spark, "ledger")).isEmpty()


# -- counted loads ----------------------------------------------------------------------------------


def test_rows_are_counted_while_they_are_written(spark):
    table, seen = counted(spark.range(57))
    table.write.format("noop").mode("overwrite").save()
    empty, none = counted(spark.range(0))
    empty.write.format("noop").mode("overwrite").save()
    assert rows(observed_counts(spark, {"a": seen, "b": none}), "table") == [("a", 57), ("b", 0)]


# -- vector tables ----------------------------------------------------------------------------------


def clusters(n, size=24, seed=1):
    import numpy as np
    random = np.random.default_rng(seed)
    centres = random.normal(size=(30, size))
    x = centres[random.integers(0, 30, n)] + random.normal(size=(n, size)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in row], "gold" if i % 3 else "all") for i, row in enumerate(x.astype("float32"))]


@pytest.mark.parametrize("block_rows, chunk_queries", [(8192, 512), (20, 7)])
def test_codes_find_most_of_the_nearest(spark, block_rows, chunk_queries):
    data = clusters(900) + [(5000 + i, None, "all") for i in range(3)] + [(6000, [0.0] * 24, "all")]
    table = spark.createDataFrame(data, "id int, vector array<float>, tier string")
    stored = VT.store_vectors(table, new_path(spark, "v"), attributes=["tier"], block_rows=block_rows)
    assert stored.vectors.count() == 901
    queries = table.filter("id < 100").select(F.col("id").alias("request_id"), "vector")
    found = VT.approximate_topk(stored, queries, 5, probes=0.2, exclude_self=True, chunk_queries=chunk_queries)
    exact = vector_topk(table.dropna(), queries, 5, exclude_self=True)
    both = exact.join(found, ["request_id", "id", "score"], "left_semi").count()
    assert both >= 0.95 * exact.count() and found.count() == exact.count()
    again = VT.open_vectors(spark, stored.path, ["tier"])
    more = VT.approximate_topk(again, queries, 5, probes=1.0, rerank=40, exclude_self=True)
    assert rows(more, "request_id", "rank") == rows(exact, "request_id", "rank")


def test_a_vector_table_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, vector array<float>")
    stored = VT.store_vectors(empty, new_path(spark, "v"))
    queries = spark.createDataFrame([(1, [1.0])], "request_id int, vector array<float>")
    assert VT.approximate_topk(stored, queries, 3).isEmpty()


def test_texts_by_vector_and_tier(spark):
    docs = [(1, "brake pedal sinks", "gold"), (2, "brake pedals sink", "all"), (3, "window glass broke", "all"),
            (4, "brake pedal", "silver")]
    table = spark.createDataFrame(docs, "id int, text string, applicable_tier string")
    stored = VT.store_text_vectors(table, new_path(spark, "v"), attributes=["applicable_tier"])
    stored = VT.open_vectors(spark, stored.path, ["applicable_tier"], texts=True)
    asked = spark.createDataFrame(
        [(1, "brake pedal sinks", "gold"), (2, "brake pedal sinks", "standard"), (3, "glass", None)],
        "request_id int, text string, customer_tier string",
    )
    best = VT.text_vector_topk(stored, asked, 1).select("request_id", "id")
    assert rows(best, "request_id") == [(1, 1), (2, 1), (3, 3)]
    pre = VT.tiered_vector_topk(stored, asked, 2).select("request_id", "rank", "id")
    assert rows(pre, "request_id", "rank") == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 3), (3, 1, 3), (3, 2, 2)]
    post = VT.tiered_vector_topk(stored, asked, 1, mode="postfilter").select("request_id", "id")
    assert rows(post, "request_id") == [(1, 1), (2, 2), (3, 3)]
    assert VT.tiered_vector_topk(stored, asked.limit(0), 2).isEmpty()
    with pytest.raises(ValueError):
        VT.tiered_vector_topk(stored, asked, mode="other")


def test_codes_are_sent_to_the_queries_in_parts(spark, monkeypatch):
    """No row per query and cell is written, and no estimates but each query's best in a part."""
    written, write_out = {}, VT.write_out

    def kept(df, name, *by):
        table = write_out(df, name, *by)
        written.setdefault(name, []).append(table)
        return table

    data = clusters(900) + [(2000 + i, clusters(1)[0][1], "all") for i in range(80)]  # one vector many times
    table = spark.createDataFrame(data, "id int, vector array<float>, tier string")
    stored = VT.store_vectors(table, new_path(spark, "v"), block_rows=50)
    queries = table.filter("id < 60").select(F.col("id").alias("request_id"), "vector")
    once = rows(VT.approximate_topk(stored, queries, 3, probes=1.0, rerank=40), "request_id", "rank")
    monkeypatch.setattr(VT, "write_out", kept)
    monkeypatch.setattr(VT, "CODE_BYTES", 300 * 80, raising=False)
    parts = rows(VT.approximate_topk(stored, queries, 3, probes=1.0, rerank=40, chunk_queries=7), "request_id", "rank")
    assert parts == once == rows(vector_topk(table, queries, 3), "request_id", "rank")
    assert "visits" not in written and len(written["estimated"]) > 2
    most = [t.groupBy("q").count().agg(F.max("count")).first()[0] for t in written["estimated"]]
    assert max(most) <= 120
