"""Values that must be the same as in the service being reproduced, and our own defaults."""

# --- Fixed values: labels and messages -------------------------------------------------
SILVER_LABELS = [("category", "カテゴリ: "), ("question", "質問: "), ("answer", "回答: ")]
CUSTOMER_NOT_FOUND = "顧客ID '%s' が見つかりません。"
VEHICLE_NOT_FOUND = "車両ID '%s' が見つかりません。"
UNKNOWN_TOOL = "未定義: %s"
ANSWER_FALLBACK = "申し訳ありません。回答を生成できませんでした。"
ANSWER_ERROR_PREFIX = "エラー: "
BOOKING_STATUS = "confirmed"
BOOKING_MESSAGE = "予約を受け付けました。予約番号: "
BOOKING_REMINDER = "前日にSMSまたはメールにてリマインドをお送りします"
RECALL_AFFECTED = "対象あり"
RECALL_REPAIRED = "改修済み"
ALL_MODELS = "全モデル"
FREE_OF_CHARGE = "無償"

# --- Fixed values: limits ---------------------------------------------------------------
DEFAULT_RESULTS = 3
OVERFETCH_FACTOR = 2
MAX_ROUNDS = 5
LOW_SCORE = 3.5
SCORE_MIN, SCORE_MAX = 1.0, 5.0
ANSWER_WORKERS = 4

# --- Fixed values: landed files, one JSON array document each ----------------------------
LANDING_FILES = {
    "faq": "faq.json",
    "customers": "customers.json",
    "vehicles": "vehicles.json",
    "service_cases": "service_cases.json",
    "eval_dataset": "eval_dataset.json",
}

# --- Fixed values: what a membership tier grants ------------------------------------------
# tier, maintenance %, trade-in bonus %, inspection %, extended warranty %,
# free towing km (None = no limit), cover abroad, free loan car, priority booking, own contact
TIER_BENEFITS = [
    ("standard", 0, 0, 0, 0, 50, False, False, False, False),
    ("silver", 15, 5, 15, 10, 100, False, False, False, False),
    ("gold", 20, 10, 20, 20, None, True, True, True, True),
]
TIER_BENEFIT_COLUMNS = [
    "tier", "maintenance_pct", "trade_in_pct", "inspection_pct", "extended_warranty_pct",
    "towing_km", "cover_abroad", "loan_car", "priority_booking", "own_contact",
]
TIERS = ["standard", "silver", "gold"]
# Whole percentages a correct answer may state for a tier (taken from the table above).
TIER_PERCENTAGES = {
    row[0]: sorted({row[1], row[2], row[3], row[4]}) for row in TIER_BENEFITS
}

# --- Fixed values: tools and their arguments ----------------------------------------------
# name -> {argument: (type, required, allowed values, default)}
TOOL_ARGUMENTS = {
    "get_customer_info": {"customer_id": ("string", True, None, None)},
    "get_vehicle_info": {"vehicle_id": ("string", True, None, None)},
    "search_faq": {
        "query": ("string", True, None, None),
        "customer_tier": ("string", True, TIERS, None),
        "num_results": ("int", False, None, 3),
    },
    "search_service_cases": {
        "query": ("string", True, None, None),
        "num_results": ("int", False, None, 3),
    },
    "book_service_appointment": {
        "customer_id": ("string", True, None, None),
        "vehicle_id": ("string", True, None, None),
        "service_type": ("string", True, None, None),
        "preferred_date": ("string", True, None, None),
        "notes": ("string", False, None, ""),
    },
}
TOOL_SPAN_TYPES = {
    "get_customer_info": "tool",
    "get_vehicle_info": "tool",
    "search_faq": "retriever",
    "search_service_cases": "retriever",
    "book_service_appointment": "tool",
}

# --- Fixed values: words the sample evaluations turn on --------------------------------------
SAFETY_WORDS = ["ブレーキ", "タイヤ", "バースト", "パンク", "ハンドル", "発煙", "火災"]
DEFER_WORDS = ["次回の", "定期点検時", "様子を見", "急ぎではありません"]
URGENT_WORDS = ["危険", "すぐに", "直ちに", "緊急", "至急", "重大"]
ACTION_WORDS = ["停止", "連絡", "予約", "走行を控え", "ロードサービス", "お持ち込み"]

# --- Fixed values: how scores are printed -----------------------------------------------------
SUMMARY_LINE = "  %-45s: %s %.2f/5.00"
LOW_LINE = "  質問: %s... | スコア: %.1f"

# --- Our own choices -----------------------------------------------------------------------
WARRANTY_ENDING_MONTHS = 3
