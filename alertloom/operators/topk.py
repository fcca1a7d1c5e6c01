"""Paged history and short lists: sort with a limit, never a full sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.operators.filters import created_date_range, history_record
from alertloom.operators.paging import history_deep_page

# Pages that begin after so many rows are found by rank; sorting all rows before them
# would gather as many in one task.
SHALLOW_ROWS = 10_000


def history_page(
    zero_day: DataFrame,
    start: str | None = None,
    end: str | None = None,
    page: int = 1,
    page_size: int = 10,
) -> DataFrame:
    """One page of novel attacks, newest first."""
    skip = (page - 1) * page_size
    if skip > SHALLOW_ROWS:
        return history_deep_page(zero_day, start, end, page, page_size)
    rows = created_date_range(zero_day, start, end).orderBy(F.desc("created_at"), F.col("id"))
    return (rows.offset(skip) if skip else rows).limit(page_size)


def history_totals(zero_day: DataFrame, start: str | None = None, end: str | None = None, page_size: int = 10) -> DataFrame:
    """Rows and pages of the filtered history."""
    total = created_date_range(zero_day, start, end).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / page_size))


def history(zero_day: DataFrame, **kwargs: object) -> DataFrame:
    """A history page as display records."""
    return history_record(history_page(zero_day, **kwargs))


def top_zero_days(detected: DataFrame, n: int = 5) -> DataFrame:
    """Flagged rows with the highest novelty score."""
    return detected.where("is_zero_day").orderBy(F.desc("zero_day_score"), F.col("id")).limit(n)


def top_high_risk(classified: DataFrame, n: int = 5) -> DataFrame:
    """Flagged rows, lowest score (most abnormal) first."""
    return classified.where("is_anomaly").orderBy("anomaly_score", "id").limit(n)


def low_risk_sample(classified: DataFrame, n: int = 5) -> DataFrame:
    """A few rows that may be filtered out, in id order."""
    return classified.where(~F.col("is_anomaly")).orderBy("id").limit(n)


def latest_zero_days(zero_day: DataFrame, n: int = 5) -> DataFrame:
    columns = ["id", "event_time", "category", "src_ip", "dst_ip", "zero_day_score", "created_at"]
    return zero_day.orderBy(F.desc("created_at"), F.col("id")).limit(n).select(*columns)
