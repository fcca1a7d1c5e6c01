"""Calendar parts and text forms of timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.schemas import TIME_COLUMNS

# Working hours are 9:00 to 17:59; names for the heat map axis.
WORK_START, WORK_END = 9, 18
WEEKDAY_NAMES = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]
FULL_FORMAT = "yyyy-MM-dd HH:mm:ss"


def is_time(df: DataFrame, column: str) -> bool:
    return column in df.columns and isinstance(df.schema[column].dataType, T.TimestampType | T.TimestampNTZType)


def is_work_hour(ts: Column) -> Column:
    """1 from 9:00 to 17:59; a missing time counts as 0."""
    hour = F.hour(ts)
    return F.coalesce(((hour >= WORK_START) & (hour < WORK_END)).cast("int"), F.lit(0))


def add_time_features(df: DataFrame) -> DataFrame:
    """Hour, day of month, weekday (Monday 0) and work-hour flag per time column."""
    added: dict[str, Column] = {}
    for column in TIME_COLUMNS:
        if is_time(df, column):
            ts = F.col(column)
            added[f"{column}_hour"] = F.hour(ts)
            added[f"{column}_day"] = F.dayofmonth(ts)
            added[f"{column}_weekday"] = F.weekday(ts)
            added[f"{column}_is_work_hour"] = is_work_hour(ts)
    return df.withColumns(added) if added else df


def date_parts(ts: Column) -> dict[str, Column]:
    return {
        "date": F.to_date(ts),
        "year": F.year(ts),
        "month": F.month(ts),
        "weekday": F.weekday(ts),
        "hour": F.hour(ts),
    }


def month_key(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year, month)


def date_texts(ts: Column) -> dict[str, Column]:
    return {
        "month_day": F.date_format(ts, "MM-dd"),
        "full": F.date_format(ts, FULL_FORMAT),
        "day": F.date_format(ts, "yyyy-MM-dd"),
        "month_key": month_key(F.year(ts), F.month(ts)),
    }
