import datetime as dt
import hashlib

from pyspark.sql import functions as F

from hibiki.operators.text_index import build_text_index
from hibiki.operators.text_search import text_topk
from hibiki.session import new_path
from hibiki.streaming import jobs as J

from conftest import rows
from test_search import everything

SCHEMA = "id int, text string, version int"


def land(spark, folder, name, *docs):
    spark.createDataFrame(list(docs), SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_index_follows_new_files(spark, tmp_path):
    folder, path = str(tmp_path / "in"), new_path(spark, "s")
    stream = lambda: J.read_files(spark, f"{folder}/*", SCHEMA)

    def sync():
        return J.sync_index_from_stream(
            stream(), path, f"{path}-progress", newest=[F.desc("version")]
        )

    land(spark, folder, "a", (1, "oil change", 1), (2, "window", 1), (2, "door", 2))
    assert everything(sync())[1] == [("change", 1), ("door", 1), ("oil", 1)]
    land(spark, folder, "b", (1, "brake pedal", 2), (3, "oil leak", 1))
    index = sync()
    now = spark.createDataFrame([(1, "brake pedal"), (2, "door"), (3, "oil leak")],
                                "id int, text string")
    assert everything(index) == everything(build_text_index(now, new_path(spark, "s")))
    assert everything(sync()) == everything(index)  # nothing new
    asked = spark.createDataFrame([(1, "oil")], "request_id int, text string")
    assert [r.id for r in text_topk(index, asked).collect()] == [3]


def test_enrichment_sees_each_request_once(spark, tmp_path):
    customers = spark.createDataFrame([("C1", "gold")], "customer_id string, tier string")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "request_id int, customer_id string"

    def run():
        stream = J.read_files(spark, f"{folder}/*", schema)
        got = J.enrich_stream(stream, customers, out, str(tmp_path / "progress"))
        return rows(got.select("request_id", "tier"), "request_id")

    spark.createDataFrame([(1, "C1"), (2, "C2")], schema).write.parquet(f"{folder}/a")
    assert run() == [(1, "gold"), (2, None)]
    spark.createDataFrame([(3, "C1")], schema).write.parquet(f"{folder}/b")
    assert run() == [(1, "gold"), (2, None), (3, "gold")]


def test_feedback_adds_up_over_runs(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "ts timestamp, thumb string"

    def run(progress="progress"):
        stream = J.read_files(spark, f"{folder}/*", schema)
        got = J.feedback_per_day(
            stream, F.col("thumb") == "up", F.col("thumb") == "down",
            str(tmp_path / "out"), str(tmp_path / progress),
        )
        return rows(got, "day")

    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    spark.createDataFrame([(at(1, 9), "up"), (at(1, 10), "down")], schema).write.parquet(
        f"{folder}/a"
    )
    assert run() == [("2024-01-01", 1, 1)]
    spark.createDataFrame([(at(1, 11), "up"), (at(2, 1), "up")], schema).write.parquet(
        f"{folder}/b"
    )
    assert run() == [("2024-01-01", 2, 1), ("2024-01-02", 1, 0)]
    # A day is never closed: rows of the first day count however late they come.
    spark.createDataFrame([(at(1, 12), "down"), (at(2, 5), "down")], schema).write.parquet(
        f"{folder}/c"
    )
    assert run() == [("2024-01-01", 2, 2), ("2024-01-02", 1, 1)]
    # A job that starts over counts from nothing, also over what an emptied checkpoint has left.
    name = hashlib.md5(str(tmp_path / "anew").encode()).hexdigest()
    left = spark.createDataFrame([("2024-01-01", 50, 50)], "day string, up long, down long")
    left.write.parquet(str(tmp_path / "out" / f"job-{name}" / "batch=7"))
    assert run("anew") == [("2024-01-01", 2, 2), ("2024-01-02", 1, 1)]
    assert run() == [("2024-01-01", 2, 2), ("2024-01-02", 1, 1)]
