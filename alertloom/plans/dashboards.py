"""Dashboard answers: statistics, charts by type, component versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.timeparts import WEEKDAY_NAMES
from alertloom.operators import aggregates as agg
from alertloom.operators.filters import recent_by_created
from alertloom.operators.sinks import last_update_times
from alertloom.schemas import CHART_DAYS, CHART_LIMIT

COMPONENTS = ["baseline_data", "baseline_model", "zero_day_model", "zero_day_detection"]


def stats(alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, as_of: str, days: int = 30) -> dict[str, DataFrame]:
    """The parts of the statistics page, each a frame of its own."""
    return {
        "baseline_count": agg.count_rows(baseline, "n"),
        "zeroday_count": agg.count_rows(zero_day, "n"),
        "daily_alerts": agg.daily_counts(alerts, "event_time", days, as_of).orderBy("date"),
        "categories": agg.value_counts(zero_day, "category"),
        "top_source_ips": agg.top_values(zero_day, "src_ip", 10),
        "monthly_trend": agg.monthly_trend(zero_day),
    }


def stats_rows(alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The same as one frame (section, name, n)."""
    names = {
        "daily_alerts": F.date_format("date", "yyyy-MM-dd"),
        "categories": F.col("category"),
        "top_source_ips": F.col("src_ip"),
        "monthly_trend": F.col("month"),
    }
    parts = [
        part.select(F.lit(section).alias("section"), names.get(section, F.lit(None)).cast("string").alias("name"), "n")
        for section, part in stats(alerts, baseline, zero_day, as_of, days).items()
    ]
    return agg.union_all(parts)


def _points(df: DataFrame, chart: str, x: str, series: object, value: str) -> DataFrame:
    return df.select(
        F.lit(chart).alias("chart"),
        F.col(x).cast("string").alias("x"),
        (F.lit(series) if isinstance(series, str) else series).alias("series"),
        F.col(value).cast("bigint").alias("value"),
    )


def _daily(alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, as_of: str, days: int, limit: int) -> DataFrame:
    return _points(agg.daily_alerts_created(alerts, as_of, days), "daily_alerts", "label", "告警数量", "n")


def _categories(alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, as_of: str, days: int, limit: int) -> DataFrame:
    counts = agg.value_counts(recent_by_created(zero_day, days, as_of), "category")
    return _points(counts, "category_distribution", "category", "零日攻击", "n")


def _heatmap(alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, as_of: str, days: int, limit: int) -> DataFrame:
    cells = agg.time_heatmap(zero_day, days, as_of).withColumn("x", F.format_string("%02d:00", "hour_of_day"))
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return _points(cells, "time_heatmap", "x", names[F.col("day_of_week")], "n")


def _sources(alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, as_of: str, days: int, limit: int) -> DataFrame:
    top = agg.top_values(recent_by_created(zero_day, days, as_of), "src_ip", limit)
    return _points(top, "ip_attack_stats", "src_ip", "攻击次数", "n")


def _comparison(alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, as_of: str, days: int, limit: int) -> DataFrame:
    table = agg.daily_comparison(alerts, baseline, zero_day, days, as_of)
    series = {"总告警数量": "total", "异常告警数量": "anomalous", "零日告警数量": "zero_day"}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.col(c).alias("n")) for n, c in series.items()]))
    long = table.select("label", pairs.alias("_p")).select("label", "_p.*")
    return _points(long, "daily_alert_comparison", "label", F.col("series"), "n")


CHARTS: dict[str, Callable[..., DataFrame]] = {
    "daily_alerts": _daily,
    "category_distribution": _categories,
    "time_heatmap": _heatmap,
    "ip_attack_stats": _sources,
    "daily_alert_comparison": _comparison,
}


def chart(
    kind: str,
    alerts: DataFrame,
    baseline: DataFrame,
    zero_day: DataFrame,
    as_of: str,
    days: int = CHART_DAYS,
    limit: int = CHART_LIMIT,
) -> DataFrame:
    """Points (chart, x, series, value) of one chart; unknown kinds are an error."""
    if kind not in CHARTS:
        raise ValueError(f"unknown chart type: {kind}")
    return CHARTS[kind](alerts, baseline, zero_day, as_of, days, limit)


def chart_points(
    alerts: DataFrame, baseline: DataFrame, zero_day: DataFrame, as_of: str, days: int = CHART_DAYS, limit: int = CHART_LIMIT
) -> DataFrame:
    """All charts in one frame."""
    return agg.union_all([chart(k, alerts, baseline, zero_day, as_of, days, limit) for k in CHARTS])


def versions(state_log: DataFrame, baseline: DataFrame, zero_day: DataFrame) -> DataFrame:
    """Last update of each component, with row counts where they belong."""
    times = last_update_times(state_log, COMPONENTS)
    component = F.when(F.col("component") == "zero_day_detection", "last_detection").otherwise(F.col("component"))
    rows = (
        F.when(F.col("component") == "baseline_data", agg.count_rows(baseline, "n").scalar())
        .when(F.col("component") == "zero_day_detection", agg.count_rows(zero_day, "n").scalar())
    )
    return times.select(component.alias("component"), F.col("last_update_text").alias("last_update"), rows.alias("n"))
