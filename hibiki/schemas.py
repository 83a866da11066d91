"""Declared schemas of the landed files, so that no read infers types."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


MESSAGE = T.StructType(_strings("role", "content"))

CUSTOMERS = T.StructType(
    _strings("customer_id", "name", "tier")
    # A string read keeps both spellings: a JSON array and an array written as JSON text.
    + _strings("vehicle_ids", "member_since", "email", "phone", "address")
)

VEHICLES = T.StructType(
    _strings("vehicle_id", "owner_id", "model", "model_type")
    + [T.StructField("year", T.IntegerType())]
    + _strings(
        "powertrain", "color", "vin", "purchase_date", "warranty_expiry",
        "powertrain_warranty_expiry", "last_inspection_date",
    )
    + [T.StructField("mileage_at_last_inspection", T.IntegerType())]
    + _strings("recall_status", "notes")
)

FAQ = T.StructType(_strings("id", "category", "question", "answer", "applicable_tier"))

SERVICE_CASES = T.StructType(
    _strings("case_id", "title")
    + [T.StructField("applicable_models", T.ArrayType(T.StringType()))]
    + _strings(
        "powertrain_type", "symptoms", "diagnosis", "solution", "cost_estimate",
        "resolution_time", "text",
    )
)

EVAL_DATASET = T.StructType(
    [T.StructField("request", T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))]))]
    + _strings("expected_response", "ground_truth_context")
)

LANDED = {
    "faq": FAQ,
    "customers": CUSTOMERS,
    "vehicles": VEHICLES,
    "service_cases": SERVICE_CASES,
    "eval_dataset": EVAL_DATASET,
}
KEYS = {"faq": "id", "customers": "customer_id", "vehicles": "vehicle_id", "service_cases": "case_id"}
