"""Counts and profiles over alert tables.

All are partial aggregations: each task reduces its rows before the shuffle, so
one key with a large share of the rows costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.scores import clamp_difference, percentage
from alertloom.functions.timeparts import month_key
from alertloom.operators.asof import moment, since

PROFILE_COLUMNS = ["category", "event_type", "signature", "src_ip", "dst_ip"]


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_tables(baseline: DataFrame, zero_day: DataFrame, alerts: DataFrame) -> DataFrame:
    """Row counts of the three tables in one row."""
    return alerts.agg(F.count(F.lit(1)).alias("alert_count")).select(
        count_rows(baseline, "n").scalar().alias("baseline_count"),
        count_rows(zero_day, "n").scalar().alias("zero_day_count"),
        "alert_count",
    )


def daily_counts(df: DataFrame, column: str, days: int, as_of: str) -> DataFrame:
    """Rows per day of `column` in the last `days`; the first day is partial."""
    recent = df.where(since(df, column, as_of, days=days))
    return recent.groupBy(F.to_date(column).alias("date")).agg(F.count(F.lit(1)).alias("n"))


def daily_alerts_created(df: DataFrame, as_of: str, days: int) -> DataFrame:
    counts = daily_counts(df, "created_at", days, as_of)
    return counts.select(F.date_format("date", "MM-dd").alias("label"), "date", "n").orderBy("date")


def value_counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows per value, most frequent first; missing values are a group of their own."""
    counts = df.groupBy(F.col(column).alias(name or column)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.col(name or column).asc_nulls_last())


def top_values(df: DataFrame, column: str, limit: int = 10, name: str | None = None) -> DataFrame:
    return value_counts(df, column, name).limit(limit)


def top_flagged(df: DataFrame, flag: str, column: str, limit: int = 10) -> DataFrame:
    """Most frequent values among flagged rows; missing values are left out."""
    return top_values(df.where(F.col(flag) & F.col(column).isNotNull()), column, limit)


def monthly_trend(df: DataFrame) -> DataFrame:
    counts = df.groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(month_key(F.col("year"), F.col("month")).alias("month"), "n").orderBy("month")


def time_heatmap(df: DataFrame, days: int, as_of: str) -> DataFrame:
    """Rows per weekday (Monday 0) and hour, with the greatest cell beside each."""
    cells = (
        df.where(since(df, "created_at", as_of, days=days))
        .groupBy(F.weekday("created_at").alias("day_of_week"), F.hour("created_at").alias("hour_of_day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most 7 x 24 cells, so the one-partition maximum is over a bounded frame.
    peak = cells.agg(F.max("n")).scalar()
    return cells.withColumn("max_count", peak).orderBy("day_of_week", "hour_of_day")


def date_spine(alerts: DataFrame, days: int, as_of: str) -> DataFrame:
    """Every date from `days` ago to today, both included."""
    last = F.lit(as_of).cast(alerts.schema["created_at"].dataType).cast("date")
    dates = F.sequence(F.date_sub(last, days), last)
    return alerts.sparkSession.range(1).select(F.explode(dates).alias("date"))


def date_spine_join(
    alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, days: int, as_of: str
) -> DataFrame:
    """Per date of the window the rows of each table, 0 where none."""
    tables = {"total": alerts, "baseline": baseline, "zero_day": zero_day}
    out = date_spine(alerts, days, as_of)
    for name, df in tables.items():
        # At most days + 1 rows per side.
        counts = daily_counts(df, "created_at", days, as_of).withColumnRenamed("n", name)
        out = out.join(F.broadcast(counts), "date", "left")
    return out.select("date", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in tables])


def daily_comparison(alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, days: int, as_of: str) -> DataFrame:
    """Per date all alerts, those outside the baseline, and novel ones.

    Empty when neither alerts nor novel attacks occur in the window.
    """
    spine = date_spine_join(alerts, baseline, zero_day, days, as_of)
    any_rows = spine.agg(F.sum(F.col("total") + F.col("zero_day"))).scalar()
    return (
        spine.where(any_rows > 0)
        .select(
            F.date_format("date", "MM-dd").alias("label"),
            "date",
            "total",
            clamp_difference(F.col("total"), F.col("baseline")).alias("anomalous"),
            "zero_day",
        )
        .orderBy("date")
    )


def report_totals(df: DataFrame, flag: str) -> DataFrame:
    flagged = F.count_if(flag)
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), flagged.alias("flagged")).select(
        "total",
        "flagged",
        (F.col("total") - F.col("flagged")).alias("normal"),
        percentage(F.col("flagged"), F.col("total")).alias("flagged_pct"),
        percentage(F.col("total") - F.col("flagged"), F.col("total")).alias("normal_pct"),
    )


def category_field(df: DataFrame) -> str | None:
    """The column that plays the category: the first one present."""
    present = [c for c in ("category", "event_type", "signature") if c in df.columns]
    return present[0] if present else None


def risk_crosstab(df: DataFrame, flag: str = "is_anomaly", limit: int = 10) -> DataFrame:
    """Flagged and normal rows per category, riskiest first."""
    field = category_field(df)
    counts = (
        df.where(F.col(field).isNotNull())
        .groupBy(F.col(field).alias("category"))
        .agg(F.count_if(~F.col(flag)).alias("normal"), F.count_if(flag).alias("anomalous"))
    )
    total = F.col("normal") + F.col("anomalous")
    risk = F.round(F.col("anomalous") / total * 100, 6)
    ranked = counts.withColumns({"total": total, "risk_pct": risk})
    return ranked.orderBy(F.desc("risk_pct"), "category").limit(limit)


def distinct_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values per column; a missing value counts as one value."""
    names = [c for c in (columns or PROFILE_COLUMNS) if c in df.columns]

    def distinct(c: str) -> Column:
        return F.approx_count_distinct(c) if approximate else F.count_distinct(F.col(c))

    return df.agg(*[(distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).alias(c) for c in names])


def time_range_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("event_time").alias("event_time_min"),
        F.max("event_time").alias("event_time_max"),
        F.min("created_at").alias("created_at_min"),
        F.max("created_at").alias("created_at_max"),
    )


def alert_overview(alerts: DataFrame, as_of: str, hours: int, approximate: bool = False) -> DataFrame:
    """Profile of the window before detection: rows, distinct values, time range."""
    now = moment(alerts, "event_time", as_of)
    window = alerts.where(F.col("event_time").between(now - F.expr(f"INTERVAL {int(hours)} HOURS"), now))
    # Each part is one row; scalar subqueries keep them in one row without a join.
    counts = distinct_profile(window, approximate=approximate)
    parts = counts.select(F.struct(*[F.col(c).alias(f"n_{c}") for c in counts.columns]).alias("s")).scalar()
    rows = window.agg(F.count(F.lit(1)).alias("total"), F.min("event_time").alias("event_time_min"),
                      F.max("event_time").alias("event_time_max"), F.min("created_at").alias("created_at_min"),
                      F.max("created_at").alias("created_at_max"))
    return rows.withColumn("_d", parts).select("total", "event_time_min", "event_time_max", "created_at_min", "created_at_max", "_d.*")


def score_range(df: DataFrame, column: str = "zero_day_score") -> DataFrame:
    return df.agg(F.min(column).alias("min_score"), F.max(column).alias("max_score"))


def dashboard_summary(baseline: DataFrame, zero_day: DataFrame, top: int = 10) -> DataFrame:
    """Counts shown at the head of the dashboard."""
    categories = zero_day.select("category").distinct().agg(F.count(F.lit(1))).scalar()
    sources = zero_day.select("src_ip").distinct().limit(top).agg(F.count(F.lit(1))).scalar()
    return zero_day.agg(F.count(F.lit(1)).alias("zero_day_count")).select(
        categories.alias("n_categories"),
        sources.alias("n_top_ips"),
        count_rows(baseline, "n").scalar().alias("baseline_count"),
        "zero_day_count",
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def lateness(alerts: DataFrame, hours: int) -> DataFrame:
    """How far creation lags behind the event, and rows later than the lookback."""
    late = F.expr("timestampdiff(SECOND, event_time, created_at)")
    return alerts.select(late.alias("late")).agg(
        F.count(F.lit(1)).alias("total"),
        F.min("late").alias("min_seconds"),
        F.max("late").alias("max_seconds"),
        F.count_if(F.col("late") > hours * 3600).alias("beyond_lookback"),
        F.count_if(F.col("late") > 1800).alias("beyond_half_hour"),
    )
