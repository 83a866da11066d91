from pyspark.sql import functions as F

from hibiki.operators.text_search import text_topk
from hibiki.operators.tools import tool_stats
from hibiki.plans.jobs import publish_latest, run_tool_calls, sync_index
from hibiki.session import new_path
from hibiki.sources.tables import read_table, save_table

from conftest import rows
from test_tools import data  # noqa: F401


def test_index_of_a_named_table(spark, tmp_path):
    path = new_path(spark, "named")
    asked = spark.createDataFrame([(1, "oil")], "request_id int, text string")
    for text, expected in [("oil change", ["a"]), ("window", [])]:
        df = spark.createDataFrame([("a", text)], "id string, text string")
        save_table(df, "passages", str(tmp_path / "passages"))
        index = sync_index(spark, "passages", path, "id")
        assert [r.id for r in text_topk(index, asked).collect()] == expected


def test_tool_log_grows(spark, data, tmp_path):  # noqa: F811
    schema = "request_id int, round int, call_id int, name string, arguments string"
    for day, n in [("d1", 1), ("d2", 2)]:
        calls = spark.createDataFrame(
            [(i, 1, i, "get_vehicle_info", '{"vehicle_id": "V101"}') for i in range(n)], schema
        )
        assert run_tool_calls(calls, data, str(tmp_path / "log"), day).count() == n
    run_tool_calls(calls, data, str(tmp_path / "log"), day)  # once more
    log = spark.read.parquet(str(tmp_path / "log"))
    assert rows(tool_stats(log), "name") == [("get_vehicle_info", "tool", 3, 0)]


def test_latest_rows_are_published(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    save_table(df, "versions", str(tmp_path / "versions"))
    publish_latest(spark, "versions", ["k"], "v", "newest", str(tmp_path / "newest"))
    assert rows(read_table(spark, "newest"), "k") == [("a", 2), ("b", 1)]
    assert read_table(spark, "newest").agg(F.sum("v")).first()[0] == 3
