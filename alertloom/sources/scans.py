"""Reads: recent alerts, time ranges, baseline, internal addresses, ad-hoc SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from alertloom.operators.asof import moment, resolve_as_of, since

# Accepted names of the address column, in order of preference.
IP_LIST_COLUMNS = ["ip_address", "ip", "address", "internal_ip"]


def read_table(spark: SparkSession, source: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Any Spark source: parquet, orc, csv, json, jdbc, or a catalog table (fmt='table')."""
    if fmt == "table":
        return spark.table(source)
    reader = spark.read.format(fmt).options(**options)
    return reader.option("dbtable", source).load() if fmt == "jdbc" else reader.load(source)


def jdbc_options(url: str, table: str, low: int, high: int, parts: int, key: str = "id") -> dict[str, str]:
    """Options for `read_table(..., fmt="jdbc")` that split the read by a numeric key.

    Without a split a database table arrives through a single task.
    """
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(parts),
        "fetchsize": "10000",
    }


def in_day_window(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Last `days` by event_time; a table partitioned by event_date skips old days."""
    out = df.where(since(df, "event_time", as_of, days=days))
    if "event_date" in df.columns:
        out = out.where(F.col("event_date") >= moment(df, "event_time", as_of, f"{int(days)} DAYS").cast("date"))
    return out


def between_times(df: DataFrame, start: object, end: object) -> DataFrame:
    """Closed interval on event_time, with the date predicate for partitioned tables."""
    low, high = moment(df, "event_time", str(start)), moment(df, "event_time", str(end))
    out = df.where(F.col("event_time").between(low, high))
    if "event_date" in df.columns:
        out = out.where(F.col("event_date").between(low.cast("date"), high.cast("date")))
    return out


def scan_recent(
    alerts: DataFrame,
    days: int | None = None,
    limit: int | None = None,
    offset: int = 0,
    as_of: str | None = None,
) -> DataFrame:
    """Alerts of the last `days`, newest first; offset counts only with a limit."""
    out = alerts
    if days is not None:
        now = resolve_as_of(alerts, "event_time", as_of)
        out = in_day_window(out, now, days)
    out = out.orderBy(F.desc("event_time"), F.col("id"))
    if limit:
        out = out.offset(offset).limit(limit) if offset else out.limit(limit)
    return out


def scan_between(alerts: DataFrame, start: str, end: str) -> DataFrame:
    """Closed interval on event_time, newest first."""
    return between_times(alerts, start, end).orderBy(F.desc("event_time"), F.col("id"))


def detection_window(alerts: DataFrame, hours: int, as_of: str) -> DataFrame:
    """Alerts of the last `hours` before `as_of` by event_time, in no order."""
    low, high = moment(alerts, "event_time", as_of, f"{int(hours)} HOURS"), moment(alerts, "event_time", as_of)
    out = alerts.where(F.col("event_time").between(low, high))
    if "event_date" in alerts.columns:
        out = out.where(F.col("event_date").between(low.cast("date"), high.cast("date")))
    return out


def scan_baseline(baseline: DataFrame) -> DataFrame:
    """The whole baseline with its times as timestamps; unreadable text becomes null."""
    out = baseline
    for column in ("event_time", "created_at"):
        if column in out.columns and isinstance(out.schema[column].dataType, T.StringType):
            out = out.withColumn(column, F.expr(f"try_cast({column} AS TIMESTAMP_NTZ)"))
    return out


def internal_ip_list(table: DataFrame) -> DataFrame:
    """Distinct internal addresses as one column `ip`, whatever the table calls it."""
    named = [c for c in IP_LIST_COLUMNS if c in table.columns]
    column = named[0] if named else table.columns[0]
    return table.select(F.col(column).alias("ip")).where(F.col("ip").isNotNull()).distinct()


def alerts_with_baseline(
    alerts: DataFrame, baseline: DataFrame, days: int | None = None, as_of: str | None = None
) -> DataFrame:
    """Both tables in one, one row per id; the alert table wins over the baseline.

    The rank filter is pushed below the shuffle as a group limit, so an id with
    very many copies sends one row per task, not all of them.
    """
    live, kept = alerts, baseline
    if days is not None:
        now = resolve_as_of(alerts, "event_time", as_of)
        live, kept = in_day_window(alerts, now, days), in_day_window(baseline, now, days)
    both = live.withColumn("from_baseline", F.lit(0)).unionByName(
        kept.withColumn("from_baseline", F.lit(1)), allowMissingColumns=True
    )
    order = Window.partitionBy("id").orderBy("from_baseline", F.desc("event_time"))
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def _question_marks(text: str) -> str:
    """%s as ?, but not inside quoted text."""
    quoted = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`"""
    return re.sub(rf"({quoted})|%s", lambda m: m[1] or "?", text)


def param_sql(spark: SparkSession, text: str, args: dict | list | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with bound values: `:name` with a dict, `?` or `%s` with a list.

    Frames given by keyword are usable in the text as {name}.
    """
    if isinstance(args, list | tuple):
        return spark.sql(_question_marks(text), args=list(args), **tables)
    return spark.sql(text, args=args or {}, **tables)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one row each."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def newest_rows(table: DataFrame, n: int = 3, column: str = "event_time") -> DataFrame:
    return table.orderBy(F.desc(column), F.col("id")).limit(n)


def freshness(alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Total, rows in the window, latest event and its lag behind `as_of` in seconds."""
    now = moment(alerts, "event_time", as_of)
    in_window = F.col("event_time").between(now - F.expr(f"INTERVAL {int(hours)} HOURS"), now)
    stats = alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(in_window).alias("in_window"),
        F.max("event_time").alias("latest"),
    )
    lag = F.expr("timestampdiff(SECOND, latest, _now)")
    return stats.withColumn("_now", F.lit(as_of).cast(alerts.schema["event_time"].dataType)).select(
        "total", "in_window", "latest", lag.alias("lag_seconds")
    )
