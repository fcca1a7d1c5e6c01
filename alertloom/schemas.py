"""Table layouts and column roles shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("device_name", T.StringType()),
        T.StructField("device_ip", T.StringType()),
        T.StructField("threat_level", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("attack_function", T.StringType()),
        T.StructField("attack_step", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("src_mac", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("dst_mac", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("packets_to_server", T.LongType()),
        T.StructField("packets_to_client", T.LongType()),
        T.StructField("bytes_to_server", T.LongType()),
        T.StructField("bytes_to_client", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)
ALERT_COLUMNS = ALERT_SCHEMA.fieldNames()

BASELINE_SCHEMA = T.StructType(ALERT_SCHEMA.fields + [T.StructField("added_to_baseline_at", T.TimestampNTZType())])
ZERO_DAY_SCHEMA = T.StructType(ALERT_SCHEMA.fields + [T.StructField("zero_day_score", T.DoubleType())])
STATE_SCHEMA = T.StructType(
    [
        T.StructField("config_key", T.StringType()),
        T.StructField("config_value", T.StringType()),
        T.StructField("last_updated", T.TimestampNTZType()),
    ]
)

# Column roles.
CATEGORICAL_COLUMNS = ["protocol", "event_type", "category", "attack_function", "attack_step", "signature"]
NUMERIC_COLUMNS = ["threat_level", "packets_to_server", "packets_to_client", "bytes_to_server", "bytes_to_client"]
IP_COLUMNS = ["src_ip", "dst_ip", "device_ip"]
PORT_COLUMNS = ["src_port", "dst_port"]
TIME_COLUMNS = ["event_time", "created_at"]
FREQUENCY_COLUMNS = [
    "event_type",
    "category",
    "src_ip",
    "src_ip_segment",
    "attack_function",
    "attack_step",
    "signature",
]

# Defaults of the jobs.
DEFAULT_EXCLUDED_CATEGORIES = ["严重漏洞", "勒索软件", "数据泄露"]
DETECTION_HOURS = 24
BASELINE_DAYS = 30
BASELINE_MIN_SCORE = 0.5
DETECTION_THRESHOLD = 0.8
TRAINING_DAYS = 30
CHART_DAYS = 7
CHART_LIMIT = 10

# Columns that scoring adds and that never reach storage.
PREDICTION_COLUMNS = [
    "isolation_forest_score",
    "kmeans_score",
    "isolation_forest_anomaly",
    "kmeans_anomaly",
    "is_anomaly",
    "anomaly_score",
]


def model_input_columns(available: list[str]) -> list[str]:
    """Feature columns in model order, kept only where present."""
    ordered: list[str] = []
    for ip in IP_COLUMNS:
        ordered += [f"{ip}_is_internal", f"{ip}_segment"]
    for port in PORT_COLUMNS:
        ordered += [f"{port}_service", f"{port}_is_common"]
    for ts in TIME_COLUMNS:
        ordered += [f"{ts}_{part}" for part in ("hour", "day", "weekday", "is_work_hour")]
    ordered.append("same_segment")
    ordered += [f"{c}_freq" for c in FREQUENCY_COLUMNS]
    ordered += ["total_bytes", "total_packets", "avg_packet_size"]
    ordered += CATEGORICAL_COLUMNS + NUMERIC_COLUMNS
    present = set(available)
    return [c for c in ordered if c in present]


def is_categorical_feature(name: str) -> bool:
    """Named categories, segments (the same-segment flag counts as one) and services."""
    return name in CATEGORICAL_COLUMNS or name.endswith(("_segment", "_service"))
