"""Row filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.timeparts import FULL_FORMAT
from alertloom.operators.asof import since
from alertloom.schemas import DEFAULT_EXCLUDED_CATEGORIES, PREDICTION_COLUMNS


def recent_by_created(df: DataFrame, days: int, as_of: str) -> DataFrame:
    return df.where(since(df, "created_at", as_of, days=days))


def exclude_categories(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Drops the listed categories; a missing category is dropped with them.

    An empty list keeps everything, missing categories too.
    """
    names = DEFAULT_EXCLUDED_CATEGORIES if categories is None else categories
    return df.where(~F.col("category").isin(names)) if names else df


def created_date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive on the date of created_at; each bound may be left out.

    Written as a range on the raw column so that it reaches the scan.
    """
    kind = df.schema["created_at"].dataType
    if start:
        df = df.where(F.col("created_at") >= F.lit(start).cast("date").cast(kind))
    if end:
        df = df.where(F.col("created_at") < F.date_add(F.lit(end).cast("date"), 1).cast(kind))
    return df


def split_by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(flagged rows, other rows)."""
    return df.where(F.col(flag)), df.where(~F.col(flag))


def select_zero_day(detected: DataFrame, detected_at: str) -> DataFrame:
    kind = detected.schema["created_at"].dataType
    return detected.where("is_zero_day").withColumn("detected_at", F.lit(detected_at).cast(kind))


def drop_score_columns(df: DataFrame) -> DataFrame:
    return df.drop(*PREDICTION_COLUMNS)


_TEXT_FIELDS = [
    "category",
    "src_ip",
    "dst_ip",
    "signature",
    "protocol",
    "device_name",
    "device_ip",
    "attack_function",
    "attack_step",
    "src_mac",
    "dst_mac",
]
_TRAFFIC_FIELDS = ["packets_to_server", "packets_to_client", "bytes_to_server", "bytes_to_client"]


def _detail_fields(df: DataFrame) -> dict[str, Column]:
    have = set(df.columns)
    out: dict[str, Column] = {"id": F.col("id"), "event_time": F.date_format("event_time", FULL_FORMAT)}
    for name in _TEXT_FIELDS:
        out[name] = F.col(name) if name in have else F.lit("Unknown")
    for name in ("src_port", "dst_port"):
        out[name] = F.col(name).cast("int") if name in have else F.lit(None).cast("int")
    for name in _TRAFFIC_FIELDS:
        out[name] = F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint")) if name in have else F.lit(0)
    score = F.coalesce(F.col("zero_day_score"), F.lit(0.0)) if "zero_day_score" in have else F.lit(0.0)
    out["zero_day_score"] = score.cast("double")
    return out


def zero_day_detail(df: DataFrame) -> DataFrame:
    """Record shown for one novel attack: absent text columns named so, times formatted."""
    return df.select(*[c.alias(n) for n, c in _detail_fields(df).items()])


def history_record(df: DataFrame) -> DataFrame:
    """Detail record plus threat level and the creation time shown as detection time."""
    fields = _detail_fields(df)
    fields["detected_at"] = F.date_format("created_at", FULL_FORMAT)
    fields["threat_level"] = F.coalesce(F.col("threat_level"), F.lit(0)).cast("int")
    return df.select(*[c.alias(n) for n, c in fields.items()])
