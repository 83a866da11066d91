import json

from pyspark.sql import functions as F

from hibiki import schemas
from hibiki.operators.changes import apply_diff, diff_snapshots, key_violations
from hibiki.operators.ranking import cap_rounds, latest_per_key
from hibiki.plans.silver import build_silver
from hibiki.sources import landing as L
from hibiki.sources import tables as T

from conftest import rows

FAQ = [
    {"id": "f1", "category": "点検", "question": "いつ?", "answer": "毎年", "applicable_tier": "all"},
    {"id": "f2", "category": None, "question": "何?", "answer": "油", "applicable_tier": "gold"},
]
CUSTOMERS = [
    {"customer_id": "C101", "name": "甲", "tier": "gold", "vehicle_ids": ["V101", "V102"]},
    {"customer_id": "C102", "name": "乙", "tier": "silver", "vehicle_ids": '["V103"]'},
    {"customer_id": "C103", "name": "丙", "tier": "standard", "vehicle_ids": '["V104"'},
    {"customer_id": "C104", "name": "丁", "tier": None, "vehicle_ids": []},
    {"customer_id": "C105", "name": "戊", "tier": "gold", "vehicle_ids": None},
]
VEHICLES = [{"vehicle_id": "V101", "owner_id": "C101", "model": "M1", "year": 2020}]


def land(folder, **tables):
    for name, content in tables.items():
        (folder / f"{name}.json").write_text(json.dumps(content, ensure_ascii=False), "utf-8")
    return str(folder)


def test_missing_files_are_reported_and_skipped(spark, tmp_path):
    found = L.landed_tables(spark, land(tmp_path, faq=FAQ))
    assert list(found) == ["faq"]
    status = {r.table: r.status for r in L.ingest_report(spark, found).collect()}
    assert status["faq"] == "copied" and status["vehicles"] == "missing" and len(status) == 5


def test_declared_types(spark, tmp_path):
    folder = land(tmp_path, vehicles=VEHICLES)
    df = L.landed_tables(spark, folder)["vehicles"]
    assert df.schema["year"].dataType.simpleString() == "int"
    assert df.first().mileage_at_last_inspection is None


def test_json_lines_and_folders(spark, tmp_path):
    (tmp_path / "faq.json").mkdir()
    for i, row in enumerate(FAQ):
        (tmp_path / "faq.json" / f"{i}.json").write_text(json.dumps(row), "utf-8")
    assert L.landed_tables(spark, str(tmp_path), lines=True)["faq"].count() == 2


def test_schema_drift(spark):
    df = spark.createDataFrame([('{"id": "1", "new": 2}',), ('{"id": "2"}',)], "j string")
    assert rows(L.schema_drift(df, "j", schemas.FAQ), "field") == [("new", 1)]


def test_build_silver_twice_gives_the_same(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = land(
        tmp_path / "in", faq=FAQ + [FAQ[0]], customers=CUSTOMERS, vehicles=VEHICLES
    )
    for _ in range(2):
        report = build_silver(spark, folder, "silver_test", str(tmp_path / "out"))
        assert rows(report.counts, "table") == [("customers", 5), ("faq", 3), ("vehicles", 1)]
        assert rows(report.violations["faq_silver"], "id") == [("f1", 2)]
        assert report.violations["customers"].count() == 0
        faq = T.read_table(spark, "silver_test.faq_silver")
        assert [r.text for r in faq.filter("id = 'f2'").collect()] == ["質問: 何?\n回答: 油"]
        ids = {r.customer_id: r.vehicle_ids
               for r in T.read_table(spark, "silver_test.customers").collect()}
        assert ids == {
            "C101": ["V101", "V102"], "C102": ["V103"], "C103": None, "C104": [], "C105": None,
        }


def test_append_and_preview(spark, tmp_path):
    path = str(tmp_path / "bookings")
    for day in ("d1", "d2"):
        df = spark.createDataFrame([("SV1", day)], "booking_id string, dt string")
        T.append_rows(df, path, ["dt"])
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    shown = T.preview(stored, ["dt"], [F.desc("dt")], 1)
    assert [r.dt for r in shown.collect()] == ["d2"]


def test_diff_applied_to_old_gives_new(spark):
    schema = "k int, a string, b double"
    old = spark.createDataFrame(
        [(1, "x", 1.0), (2, "y", None), (3, "z", 3.0), (4, None, float("nan"))], schema
    )
    new = spark.createDataFrame(
        [(1, "x", 1.0), (2, "y", 2.0), (4, None, float("nan")), (5, "n", None)], schema
    )
    changes = diff_snapshots(old, new, "k")
    kinds = sorted((r.k, r._change_type) for r in changes.collect())
    assert kinds == [
        (2, "update_postimage"), (2, "update_preimage"), (3, "delete"), (5, "insert"),
    ]
    after = apply_diff(old, changes, "k").select("k", "a", F.col("b").cast("string"))
    wanted = new.select("k", "a", F.col("b").cast("string"))
    assert rows(after, "k") == rows(wanted, "k")
    assert diff_snapshots(new, new, "k").count() == 0


def test_key_violations(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert rows(key_violations(df, ["k"]), "k") == [(None, 1), ("a", 2)]


def test_latest_and_rounds(spark):
    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 11), ("a", 2, 12), ("b", 1, 13)], "k string, v int, id int"
    )
    newest = latest_per_key(df, ["k"], [F.desc("v"), F.desc("id")])
    assert rows(newest, "k") == [("a", 2, 12), ("b", 1, 13)]
    many = spark.range(8).select(
        F.lit(1).alias("request_id"), F.floor(F.col("id") / 1).alias("ts")
    )
    assert cap_rounds(many, 5, "request_id", order=[F.asc("ts")]).count() == 5
    assert cap_rounds(many, 5, "request_id", "ts").count() == 6
