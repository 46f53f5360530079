"""Fixed schemas of the inputs and of the three result tables."""

from pyspark.sql import types as T


def _fields(spec: list[tuple[str, T.DataType, bool]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in spec])


_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

# Raw billing rows as exported. The date is text because exports mix formats.
BILLING = _fields([
    ("date", _S, True),
    ("provider", _S, True),
    ("service", _S, True),
    ("team", _S, True),
    ("environment", _S, True),
    ("resource_id", _S, True),
    ("cost_usd", _D, True),
    ("usage_quantity", _D, True),
    ("usage_unit", _S, True),
    ("region", _S, True),
    ("is_anomaly", _I, True),
])

# Bulk variant: category instead of service, narrow numeric types.
BILLING_BULK = _fields([
    ("date", _S, True),
    ("provider", _S, True),
    ("service_category", _S, True),
    ("team", _S, True),
    ("environment", _S, True),
    ("cost_usd", T.FloatType(), True),
    ("usage_quantity", T.FloatType(), True),
    ("region", _S, True),
    ("is_anomaly", T.ByteType(), True),
])

# Provider export variant: product names that still need the taxonomy.
BILLING_EXPORT = T.StructType(
    [T.StructField("service_name", _S) if f.name == "service" else f for f in BILLING.fields]
)

ANOMALY_LOGS = _fields([
    ("id", _L, False),
    ("date", T.TimestampType(), False),
    ("provider", _S, False),
    ("service_category", _S, False),
    ("team", _S, False),
    ("cost_usd", _D, True),
    ("is_anomaly", _B, True),
    ("severity_label", _S, True),
    ("severity_score", _D, True),
    ("root_cause", _S, True),
    ("llm_insight", _S, True),
    ("recommended_action", _S, True),
    ("estimated_savings", _S, True),
    ("model_votes", _I, True),
    ("created_at", T.TimestampType(), True),
    ("impact_score", _D, True),
    ("priority", _S, True),
])

FORECAST_RESULTS = _fields([
    ("id", _L, False),
    ("date", T.TimestampType(), False),
    ("provider", _S, False),
    ("service_category", _S, False),
    ("team", _S, False),
    ("forecast_50", _D, True),
    ("forecast_90", _D, True),
    ("forecast_10", _D, True),
    ("horizon_days", _I, True),
    ("created_at", T.TimestampType(), True),
])

MODEL_METRICS = _fields([
    ("id", _L, False),
    ("model_name", _S, False),
    ("f1_score", _D, False),
    ("precision_score", _D, False),
    ("recall_score", _D, False),
    ("mape", _D, False),
    ("created_at", T.TimestampType(), True),
])

# Column that holds a CSV line which did not fit its schema.
MALFORMED = "_malformed"

# Rows that no result was made of: why, where they were turned away, and the row as JSON.
REJECTS = _fields([
    ("reason", _S, False),
    ("stage", _S, False),
    ("row", _S, True),
])

# Rows of each live batch: arrived = kept + rejected; and the verdicts it stored.
LIVE_BATCHES = _fields([
    ("arrived", _L, False),
    ("kept", _L, False),
    ("rejected", _L, False),
    ("verdicts", _L, False),
])

# Wider tables the reference computes but never stores.
BREACH_RESULTS = _fields([
    ("service_category", _S, False),
    ("breach_probability", _D, True),
    ("breach_date_50", _S, True),
    ("breach_date_90", _S, True),
    ("trajectory", _S, True),
])

CORRELATED_RESULTS = _fields([
    ("date", T.DateType(), False),
    ("services_spiking", _L, True),
    ("correlated_anomaly", _I, True),
])

ANOMALY_CAUSES = _fields([
    ("date", T.DateType(), False),
    ("provider", _S, False),
    ("service_category", _S, False),
    ("team", _S, False),
    ("environment", _S, False),
    ("top_causes", T.ArrayType(_fields([("root_cause", _S, True), ("shap_value", _D, True), ("abs_impact", _D, True)])), True),
    ("primary_cause", _S, True),
    ("impact_score", _D, True),
])

TABLES = {
    "anomaly_logs": ANOMALY_LOGS,
    "forecast_results": FORECAST_RESULTS,
    "model_metrics": MODEL_METRICS,
    "budget_breaches": BREACH_RESULTS,
    "correlated_anomalies": CORRELATED_RESULTS,
    "anomaly_causes": ANOMALY_CAUSES,
    "rejects": REJECTS,
    "live_batches": LIVE_BATCHES,
}

# Lengths the row contract may enforce on text columns.
TEXT_LIMITS = {
    "provider": 20,
    "service_category": 50,
    "team": 50,
    "severity_label": 10,
    "estimated_savings": 50,
    "priority": 20,
    "model_name": 50,
}

# One series = one value of these columns; one row of it per day.
SERIES_KEYS = ("provider", "service_category", "team", "environment")
# Total order of the rows of one service.
ROW_KEY = ("service_category", "date", "provider", "team", "environment")
