import json

import pytest

from hibiki import constants as C
from hibiki.operators import enrich as E
from hibiki.operators import tools as T
from hibiki.operators.text_index import build_text_index
from hibiki.plans.context import build_context, identify
from hibiki.session import new_path

from conftest import rows

CUSTOMERS = [
    ("C101", "甲", "gold", ["V101", "V102"]), ("C102", "乙", "silver", []),
    ("C103", "丙", None, None), ("C104", "丁", "standard", ["V999"]),
]
VEHICLES = [("V101", "C101", "M1"), ("V102", "C101", "M2"), ("V103", "C102", "M1")]
FAQ = [
    ("f1", "点検", "油の交換は", "半年ごと", "all"), ("f2", "会員", "油の割引は", "二割", "gold"),
    ("f3", "会員", "油の割引は", "一割半", "silver"), ("f4", "窓", "窓が動かない", "交換", "all"),
]
CASES = [
    ("K1", "異音", ["M1"], "カラカラ", "油を補充", "3,000円", None),
    ("K2", "窓", [C.ALL_MODELS], "窓が動かない", "交換", "無償", "1時間"),
    ("K3", "漏れ", ["M9"], "水が漏れる", "配管", "無償", "1日"),
]


@pytest.fixture(scope="module")
def data(spark):
    faq = spark.createDataFrame(
        FAQ, "id string, category string, question string, answer string, applicable_tier string"
    ).selectExpr("*", "concat(question, answer) as text")
    cases = spark.createDataFrame(
        CASES, "case_id string, title string, applicable_models array<string>, symptoms string, "
        "solution string, cost_estimate string, resolution_time string"
    ).selectExpr("*", "concat(title, symptoms, solution) as text")
    return T.ToolData(
        customers=spark.createDataFrame(
            CUSTOMERS, "customer_id string, name string, tier string, vehicle_ids array<string>"
        ),
        vehicles=spark.createDataFrame(VEHICLES, "vehicle_id string, owner_id string, model string"),
        faq=faq,
        faq_index=build_text_index(faq, new_path(spark, "f"), "id", "text", ["applicable_tier"]),
        cases=cases,
        case_index=build_text_index(cases, new_path(spark, "c"), "case_id"),
    )


def run(spark, data, *calls):
    df = spark.createDataFrame(
        [(1, r, i, n, a if isinstance(a, str) else json.dumps(a))
         for i, (r, n, a) in enumerate(calls)],
        "request_id int, round int, call_id int, name string, arguments string",
    )
    log = T.run_tools(df, data)
    return {r.call_id: r for r in log.collect()}, log


def test_all_tools_in_one_log(spark, data):
    log, df = run(
        spark, data,
        (1, "get_customer_info", {"customer_id": "C101"}),
        (1, "get_customer_info", {"customer_id": "C999"}),
        (1, "get_vehicle_info", {"vehicle_id": "V101"}),
        (2, "search_faq", {"query": "油の割引", "customer_tier": "gold"}),
        (2, "search_service_cases", {"query": "カラカラ", "num_results": 1}),
        (2, "book_service_appointment", {"customer_id": "C101", "vehicle_id": "V101",
                                         "service_type": "点検", "preferred_date": "2025/01/05"}),
        (3, "no_such_tool", {}),
        (3, "get_vehicle_info", {}),
        (3, "get_vehicle_info", "{broken"),
        (3, "search_faq", {"query": "油", "customer_tier": "platinum"}),
        (5, "search_faq", {"query": "zzz", "customer_tier": "gold"}),
        (6, "get_vehicle_info", {"vehicle_id": "V101"}),
        (5, None, {}),
        (5, "search_service_cases", {"query": "窓が動かない", "num_results": 0}),
        (5, "search_service_cases", {"query": "窓が動かない", "num_results": 5000}),
    )
    content = {i: json.loads(r.content) for i, r in log.items()}
    assert content[0] == {"customer_id": "C101", "name": "甲", "tier": "gold",
                          "vehicle_ids": ["V101", "V102"]}
    assert content[1] == {"error": "顧客ID 'C999' が見つかりません。"}
    assert content[2]["model"] == "M1"
    assert [h["id"] for h in content[3]] == ["f2", "f1"]
    assert list(content[3][0]) == ["id", "category", "question", "answer", "applicable_tier"]
    assert content[4] == [{"case_id": "K1", "title": "異音", "symptoms": "カラカラ",
                           "solution": "油を補充", "cost_estimate": "3,000円",
                           "resolution_time": None}]
    booking = content[5]
    assert booking["booking_id"].startswith("SV") and len(booking["booking_id"]) == 7
    assert booking["status"] == "confirmed" and booking["notes"] == ""
    assert booking["message"].endswith(booking["booking_id"])
    assert content[6] == {"error": "未定義: no_such_tool"}
    assert content[7] == content[8] == {"error": "引数エラー: missing vehicle_id"}
    assert content[9] == {"error": "引数エラー: invalid customer_tier"}
    assert content[10] == []
    assert 11 not in log  # the sixth round
    assert 12 in log and log[12].span_type is None
    assert content[13] == []
    assert [h["case_id"] for h in content[14]][0] == "K2"
    assert log[3].span_type == "retriever" and log[0].span_type == "tool"
    stats = {r.name: (r.calls, r.errors) for r in T.tool_stats(df).collect()}
    assert stats["get_customer_info"] == (2, 1) and stats["search_faq"] == (3, 1)


def test_arguments_of_a_wrong_type(spark):
    given = [
        ("search_faq", '{"query": "a", "customer_tier": "gold", "num_results": "2"}'),
        ("search_faq", '{"query": "a", "customer_tier": "gold", "num_results": 2.5}'),
        ("search_faq", '{"query": "a", "customer_tier": "gold", "num_results": 3000000000}'),
        ("search_faq", '{"query": "a", "customer_tier": "gold", "num_results": -1}'),
        ("search_faq", '{"query": 5, "customer_tier": ["gold"], "num_results": null}'),
        ("search_faq", '{"query": "a", "customer_tier": "gold", "num_results": 4, "notes": 1}'),
        ("get_vehicle_info", '{"vehicle_id": null}'),
        ("get_vehicle_info", "[1]"),
        ("get_vehicle_info", None),
    ]
    calls = spark.createDataFrame(
        [(i, *g) for i, g in enumerate(given)], "call_id int, name string, arguments string"
    )
    found = T.parse_arguments(calls).select("call_id", T.argument_violations())
    assert [r[1] for r in found.orderBy("call_id").collect()] == [
        ["wrong type num_results"], ["wrong type num_results"], ["wrong type num_results"],
        ["invalid num_results"], ["wrong type query", "wrong type customer_tier"], [],
        ["missing vehicle_id"], ["missing vehicle_id"], ["missing vehicle_id"],
    ]


def test_asks_are_searched_with_others_of_their_size(spark):
    asks = spark.createDataFrame([(n,) for n in (0, 1, 3, 7, 8, 5000)], "num_results int")
    got = [(most, sorted(r[0] for r in part.collect())) for part, most in T._by_size(asks)]
    assert got == [(7, [0, 1, 3, 7]), (8, [8]), (5000, [5000])]
    assert [most for _part, most in T._by_size(asks.limit(0))] == [1]


def test_listed_vehicles_are_an_array(spark):
    calls = spark.createDataFrame([("C1",)], "customer_id string").selectExpr(
        "1 AS request_id", "1 AS round", "1 AS call_id", "'get_customer_info' AS name",
        "struct(customer_id) AS args",
    )
    table = spark.createDataFrame([("C1", '["V1","V2"]')], "customer_id string, vehicle_ids string")
    found = T._record(calls, table, "customer_id", C.CUSTOMER_NOT_FOUND).first()
    assert json.loads(found.content)["vehicle_ids"] == ["V1", "V2"]


def test_bookings_are_stable(spark):
    def calls():
        return spark.createDataFrame(
            [("c1", "book_service_appointment", json.dumps(
                {"customer_id": "C1", "vehicle_id": "V1", "service_type": "s",
                 "preferred_date": "2025/01/05", "notes": "n"})),
             ("c2", "book_service_appointment", "{}")],
            "call_id string, name string, arguments string",
        )

    first, second = T.bookings(calls()).collect(), T.bookings(calls()).collect()
    assert first == second and len(first) == 1
    assert 10000 <= int(first[0].booking_id[2:]) <= 99999


def test_vehicle_links_in_any_spelling(spark):
    arrays = spark.createDataFrame(CUSTOMERS, "customer_id string, name string, tier string, "
                                   "vehicle_ids array<string>")
    texts = spark.createDataFrame(
        [("C1", '["V1"]'), ("C2", '["V2'), ("C3", None)], "customer_id string, vehicle_ids string"
    )
    assert rows(E.vehicle_links(arrays), "customer_id", "position") == [
        ("C101", 0, "V101"), ("C101", 1, "V102"), ("C104", 0, "V999"),
    ]
    assert rows(E.vehicle_links(texts), "customer_id") == [("C1", 0, "V1")]


def test_enrichment_keeps_every_request(spark, data):
    asked = spark.createDataFrame(
        [(1, "C101"), (2, "C102"), (3, "C999"), (4, None), (5, "C104")],
        "request_id int, customer_id string",
    )
    found = {r.request_id: r for r in E.enrich_customers(asked, data.customers).collect()}
    assert len(found) == 5 and found[1].tier == "gold" and found[1].error is None
    assert found[3].error == "顧客ID 'C999' が見つかりません。" and found[4].error is not None
    fleet = E.enrich_vehicles(asked, E.vehicle_links(data.customers), data.vehicles)
    got = rows(fleet.select("request_id", "vehicle_id", "model", "error"), "request_id", "vehicle_id")
    assert got == [
        (1, "V101", "M1", None), (1, "V102", "M2", None), (2, None, None, None),
        (3, None, None, None), (4, None, None, None),
        (5, "V999", None, "車両ID 'V999' が見つかりません。"),
    ]


def test_link_mismatches(spark, data):
    got = E.link_mismatches(E.vehicle_links(data.customers), data.vehicles)
    assert rows(got, "customer_id") == [
        ("C102", "V103", "owned_not_listed"), ("C104", "V999", "listed_not_owned"),
    ]


def test_case_models_are_marked_not_filtered(spark, data):
    hits = spark.createDataFrame(
        [(1, "C101", "K1"), (1, "C101", "K2"), (1, "C101", "K3"), (2, "C102", "K2"),
         (2, "C102", "K1"), (3, None, "K3")],
        "request_id int, customer_id string, case_id string",
    )
    got = E.match_case_models(hits, data.cases, E.vehicle_links(data.customers), data.vehicles)
    got = rows(got.select("request_id", "case_id", "model_match"), "request_id", "case_id")
    assert got == [(1, "K1", True), (1, "K2", True), (1, "K3", False), (2, "K1", False),
                   (2, "K2", True), (3, "K3", False)]


def test_context(spark, data):
    asked = identify(spark.createDataFrame(
        [(1, "顧客ID C101です。油の割引は?"), (2, "窓が動かない"), (3, "C999です。油")],
        "request_id int, text string",
    ))
    got = build_context(asked, data, E.vehicle_links(data.customers), "PROMPT", k=2)
    got = got.orderBy("request_id", "part", "position").collect()
    first = [(r.part, r.position, r.ref_id, r.role) for r in got if r.request_id == 1]
    assert first[:5] == [(0, 0, None, "system"), (1, 0, None, "user"), (2, 0, "C101", "tool"),
                         (3, 0, "V101", "tool"), (3, 1, "V102", "tool")]
    assert [r.ref_id for r in got if r.request_id == 1 and r.part == 4][0] == "f2"
    # Nobody is named: no customer record, and the passages are those of a standard member.
    second = [r for r in got if r.request_id == 2]
    assert {r.part for r in second} == {0, 1, 4, 5}
    assert [r.ref_id for r in second if r.part == 4] == ["f4"]
    third = {r.part: r for r in got if r.request_id == 3}
    assert json.loads(third[2].content) == {"error": "顧客ID 'C999' が見つかりません。"}
    assert 3 not in third
