import datetime as dt

import pytest
from pyspark.sql import functions as F

from hibiki import constants as C
from hibiki.functions import scores as SC
from hibiki.functions import text as TX
from hibiki.functions import tiers as TR
from hibiki.functions import vehicles as VH


def value(spark, column, **given):
    """The column's value for one row of given values."""
    names = [f"{k} {t}" for k, (t, _) in given.items()]
    df = spark.createDataFrame([tuple(v for _, v in given.values())], ", ".join(names))
    return df.select(column.alias("x")).first().x


def s(text):
    return ("string", text)


def test_tokens_with_and_without_unspaced_letters(spark):
    texts = ["Straße ÉTÉ x1 ٣٤ e\u0301t", "Ünï 々x ー音 ok", "\u2e80a b", "😀smile x😀y", "a_b-c"]
    low = F.lower("t")
    both = F.concat(*[
        F.regexp_extract_all(low, F.lit(p), F.lit(g))
        for p, g in ((TX._WORD, 0), (TX._PAIR, 1), (TX._SINGLE, 0))
    ])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", TX.tokens(F.col("t")).alias("found"), both.alias("each")).collect():
        assert row.found == row.each, row.t


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Hello, World 12", ["hello", "world", "12"]),
        ("ブレーキが鳴る", ["ブレ", "レー", "ーキ", "キが", "が鳴", "鳴る"]),
        ("EV車。", ["ev", "車"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, expected):
    assert value(spark, TX.tokens(F.col("t")), t=s(text)) == expected


def test_long_unspaced_text_is_tokenised_whole(spark):
    assert len(value(spark, TX.tokens(F.col("t")), t=s("音" * 50_000))) == 49_999


def test_silver_text_leaves_out_null_lines(spark):
    text = TX.silver_text(F.col("a"), F.col("b"), F.col("c"))
    assert value(spark, text, a=s("x"), b=s("y"), c=s("z")) == "カテゴリ: x\n質問: y\n回答: z"
    assert value(spark, text, a=s(None), b=s("y"), c=s("z")) == "質問: y\n回答: z"


def test_shorten_always_adds_dots(spark):
    assert value(spark, TX.shorten(F.col("t"), 3), t=s("ab")) == "ab..."
    assert value(spark, TX.shorten(F.col("t"), 3), t=s("abcd")) == "abc..."


@pytest.mark.parametrize("text", [None, ""])
def test_final_answer_falls_back(spark, text):
    assert value(spark, TX.final_answer(F.col("t")), t=s(text)) == C.ANSWER_FALLBACK


def test_json_list(spark):
    assert value(spark, TX.json_list(F.col("t")), t=s('["V1", "V2"]')) == ["V1", "V2"]
    assert value(spark, TX.json_list(F.col("t")), t=s('["V1"')) is None


def test_as_json_keeps_nulls_and_letters(spark):
    got = value(spark, TX.as_json(F.col("a"), F.col("b")), a=s(None), b=s("顧客"))
    assert got == '{"a":null,"b":"顧客"}'


def test_first_id(spark):
    assert value(spark, TX.first_id(F.col("t"), "C"), t=s("顧客ID C0012です。C999")) == "C0012"
    assert value(spark, TX.first_id(F.col("t"), "V"), t=s("V12 は短い")) is None


def test_slash_date(spark):
    assert value(spark, TX.slash_date(F.col("t")), t=s("2024/02/29")) == dt.date(2024, 2, 29)
    assert value(spark, TX.slash_date(F.col("t")), t=s("2024-02-29")) is None
    assert value(spark, TX.slash_date(F.col("t")), t=s("2023/02/29")) is None


def test_template_does_not_scan_what_it_puts_in(spark):
    filled = TX.fill_template("Q {q} P {p} {other}", {"q": F.col("a"), "p": F.col("b")})
    assert value(spark, filled, a=s("{p}"), b=s(None)) == "Q {p} P  {other}"


@pytest.mark.parametrize(
    "applicable, tier, expected",
    [
        ("all", "gold", True), ("all", None, True), ("gold", "gold", True),
        ("gold", "silver", False), ("silver,gold", "gold", True), ("gold", "", True),
        (None, "gold", False), ("gold", None, False),
    ],
)
def test_tier_allows(spark, applicable, tier, expected):
    got = value(spark, TR.tier_allows(F.col("a"), F.col("b")), a=s(applicable), b=s(tier))
    assert got is expected


def test_benefits(spark):
    rows = {r.tier: r for r in TR.benefits(spark).collect()}
    assert [rows[t].maintenance_pct for t in C.TIERS] == [0, 15, 20]
    assert rows["gold"].towing_km is None and rows["gold"].priority_booking
    df = spark.createDataFrame([("gold",), ("bronze",), (None,)], "tier string")
    assert TR.with_benefits(df).count() == 3


def test_discounted(spark):
    price = TR.discounted(F.lit(1000.0), F.col("p").cast("int"))
    assert value(spark, price, p=s("15")) == 850.0
    assert value(spark, price, p=s(None)) == 1000.0


@pytest.mark.parametrize(
    "tier, since, bought, expected",
    [
        ("silver", "2020-01-01", None, True),
        ("silver", "2023-01-01", None, False),
        ("silver", "2023-01-01", "2022-06-15", True),
        ("silver", "2023-01-01", "2022-06-14", False),
        ("standard", "2010-01-01", "2025-01-01", False),
        ("silver", None, None, False),
    ],
)
def test_upgrade(spark, tier, since, bought, expected):
    as_of = F.to_date(F.lit("2025-06-15"))
    yes = TR.upgrade_eligible(F.col("t"), F.to_date("s"), F.to_date("b"), as_of)
    assert value(spark, yes, t=s(tier), s=s(since), b=s(bought)) is expected
    start = TR.upgrade_effective(F.to_date(F.lit("2025-12-31")))
    assert value(spark, start, t=s(tier)) == dt.date(2026, 1, 1)


def test_recall(spark):
    for status, affected, repaired in [
        ("対象なし", False, False), ("対象あり", True, False), ("対象あり（改修済み）", True, True),
    ]:
        assert value(spark, VH.recall_affected(F.col("r")), r=s(status)) is affected
        assert value(spark, VH.recall_repaired(F.col("r")), r=s(status)) is repaired


@pytest.mark.parametrize(
    "text, low, high, free",
    [
        ("部品1,000円 + 工賃2,000円 = 約3,000円", 3000, 3000, False),
        ("無償（更新のみ）", None, None, True),
        ("約70,000〜90,000円（大きさによる）", 70000, 90000, False),
        ("補充のみ：500円。点検を含む：部品100円 + 工賃900円 = 1,000円", 500, 1000, False),
        ("12,000円〜", 12000, 12000, False),
        ("電池100〜200円", 100, 200, False),
        ("更新は無償。交換は約300,000円", 300000, 300000, True),
    ],
)
def test_cost_texts(spark, text, low, high, free):
    assert value(spark, VH.cost_low(F.col("c")), c=s(text)) == low
    assert value(spark, VH.cost_high(F.col("c")), c=s(text)) == high
    assert value(spark, VH.cost_free(F.col("c")), c=s(text)) is free


@pytest.mark.parametrize(
    "expiry, km, expected",
    [
        ("2025-01-01", None, "valid"), ("2024-08-31", None, "ending"),
        ("2024-06-01", None, "ending"), ("2024-05-31", None, "expired"),
        ("2025-01-01", "60001", "expired"), ("2025-01-01", "60000", "valid"),
        (None, "1", None),
    ],
)
def test_warranty(spark, expiry, km, expected):
    state = VH.warranty_state(
        F.to_date("e"), F.to_date(F.lit("2024-06-01")), F.col("m").cast("int"), 60_000
    )
    assert value(spark, state, e=s(expiry), m=s(km)) == expected


@pytest.mark.parametrize(
    "score, bar", [(0.0, "░░░░░"), (3.9, "███░░"), (5.0, "█████"), (6.2, "██████"), (-1.0, "░" * 6)]
)
def test_score_bar(spark, score, bar):
    assert value(spark, SC.score_bar(F.col("v")), v=("double", score)) == bar


def test_summary_line_does_not_cut_long_names(spark):
    name = "m" * 50
    line = value(spark, SC.summary_line(F.lit(name), F.col("v")), v=("double", 4.0))
    assert line == f"  {name}: ████░ 4.00/5.00"
    short = value(spark, SC.summary_line(F.lit("a"), F.col("v")), v=("double", 4.256))
    assert short == f"  {'a':<45}: ████░ 4.26/5.00"


@pytest.mark.parametrize(
    "response, tier, expected",
    [
        ("車検は20%割引です", "gold", 5), ("整備は20%割引です", "silver", 2),
        ("割引があります", "gold", 3), ("15％と10 %", "silver", 5), ("２０％", "gold", 5),
        ("30%または40%", "gold", 1), ("20%", None, 2), (None, "gold", 3), ("0%", "standard", 5),
    ],
)
def test_tier_rule(spark, response, tier, expected):
    got = value(spark, SC.tier_rule(F.col("r"), F.col("t")), r=s(response), t=s(tier))
    assert got == expected


@pytest.mark.parametrize(
    "question, response, expected",
    [
        ("ブレーキが効きません", "危険です。すぐに停止してご連絡ください", 5),
        ("ブレーキが効きません", "次回の点検でご相談ください", 1),
        ("ブレーキが効きません", "とても危険です", 4),
        ("ブレーキが効きません", "ブレーキは消耗します", 3),
        ("ブレーキが効きません", "そうですか", 2),
        ("洗車の料金は", "千円です", 5),
        ("ブレーキが効きません", None, 2),
    ],
)
def test_safety_rule(spark, question, response, expected):
    got = value(spark, SC.safety_rule(F.col("q"), F.col("r")), q=s(question), r=s(response))
    assert got == expected
