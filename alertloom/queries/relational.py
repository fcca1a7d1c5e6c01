"""Registered queries: scans, sinks, filters, joins, aggregates, sorted lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions import scores, timeparts, traffic
from alertloom.operators import aggregates as agg
from alertloom.operators import filters, joins, paging, profiles, quantiles, sinks, topk
from alertloom.operators.frequency import value_frequency
from alertloom.plans import dashboards
from alertloom.queries.registry import Query, checked
from alertloom.schemas import ALERT_COLUMNS, BASELINE_SCHEMA, CHART_DAYS, DETECTION_HOURS, ZERO_DAY_SCHEMA
from alertloom.sources import scans
from alertloom.sources.views import Views
from alertloom.storage import materialise, scratch_path

ALL = ", ".join(ALERT_COLUMNS)


def _window_profile(v: Views) -> DataFrame:
    """Rows of a window, and whether the distinct values that the day sketches give are within 5 % of those counted."""
    sketches = materialise(profiles.daily_sketches(v.alerts), "day-sketches")
    about = profiles.window_profile(sketches, "2024-01-05", "2024-01-19")
    window = v.alerts.where("event_time >= DATE '2024-01-05' AND event_time < DATE '2024-01-20'")
    exact = agg.distinct_profile(window).first()
    return about.select("rows", *[(F.abs(F.col(c) - exact[c]) <= F.lit(0.05 * exact[c])).alias(c) for c in agg.PROFILE_COLUMNS])


def _scans() -> dict[str, Query]:
    recent = f"SELECT {ALL} FROM alerts, p WHERE event_time >= as_of_event - INTERVAL 7 DAY"
    texts = (
        "texts AS (SELECT *, CASE WHEN threat_level = 20 THEN 'no date' ELSE cast(event_time as varchar) END AS t FROM baseline_alerts)"
    )
    return {
        "scan_alerts_recent": checked(lambda v: scans.scan_recent(v.alerts, days=7, as_of=v.as_of_event), recent),
        "scan_alerts_page": checked(
            lambda v: scans.scan_recent(v.alerts, days=7, limit=100, offset=50, as_of=v.as_of_event),
            f"{recent} ORDER BY event_time DESC, id LIMIT 100 OFFSET 50",
        ),
        "scan_alerts_between": checked(
            lambda v: scans.scan_between(v.alerts, "2024-01-10 06:00:00", "2024-01-12 18:00:00"),
            f"SELECT {ALL} FROM alerts WHERE event_time BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'",
        ),
        "scan_baseline": checked(
            lambda v: scans.scan_baseline(
                v.baseline.withColumn("event_time", F.when(F.col("threat_level") == 20, "no date").otherwise(F.col("event_time").cast("string")))
            ),
            f"SELECT {ALL.replace('event_time', 'try_cast(t as timestamp) AS event_time')}, added_to_baseline_at FROM texts",
            texts,
        ),
        "scan_internal_ips": checked(lambda v: scans.internal_ip_list(v.internal_ips), "SELECT ip_address AS ip FROM ip_address"),
        "alerts_with_baseline": checked(
            lambda v: scans.alerts_with_baseline(v.alerts, v.baseline, days=30, as_of=v.as_of_event).select(
                *ALERT_COLUMNS, "added_to_baseline_at", "from_baseline"
            ),
            f"SELECT {ALL}, added_to_baseline_at, from_baseline FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY from_baseline, event_time DESC) AS r FROM ("
            f"SELECT {ALL}, cast(null as timestamp) AS added_to_baseline_at, 0 AS from_baseline FROM alerts, p WHERE event_time >= as_of_event - INTERVAL 30 DAY "
            f"UNION ALL SELECT {ALL}, added_to_baseline_at, 1 FROM baseline_alerts, p WHERE event_time >= as_of_event - INTERVAL 30 DAY)) WHERE r = 1",
        ),
        "param_sql": checked(
            lambda v: scans.param_sql(
                v.spark,
                "SELECT category, count(*) AS n FROM {alerts} WHERE threat_level >= :level AND event_time >= cast(:since AS timestamp_ntz) GROUP BY category",
                {"level": 20, "since": "2024-01-15 00:00:00"},
                alerts=v.alerts,
            ),
            "SELECT category, count(*) AS n FROM alerts WHERE threat_level >= 20 AND event_time >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY category",
        ),
        "param_sql_positional": checked(
            lambda v: scans.param_sql(
                v.spark, "SELECT signature, count(*) AS n FROM {alerts} WHERE protocol = %s AND threat_level > %s GROUP BY signature", ["TCP", 10], alerts=v.alerts
            ),
            "SELECT signature, count(*) AS n FROM alerts WHERE protocol = 'TCP' AND threat_level > 10 GROUP BY signature",
        ),
        "table_profile_counts": checked(
            lambda v: scans.table_counts({"alerts": v.alerts, "baseline_alerts": v.baseline, "zero_day_alerts": v.zero_day, "ip_address": v.internal_ips}),
            "SELECT 'alerts' AS table_name, count(*) AS n_rows FROM alerts UNION ALL SELECT 'baseline_alerts', count(*) FROM baseline_alerts "
            "UNION ALL SELECT 'zero_day_alerts', count(*) FROM zero_day_alerts UNION ALL SELECT 'ip_address', count(*) FROM ip_address",
        ),
        "table_profile_samples": checked(
            lambda v: scans.newest_rows(v.zero_day.select("id", "event_time", "event_type", "zero_day_score")),
            "SELECT id, event_time, event_type, zero_day_score FROM zero_day_alerts ORDER BY event_time DESC, id LIMIT 3",
        ),
        "freshness": checked(
            lambda v: scans.freshness(v.alerts, v.as_of, hours=DETECTION_HOURS),
            "SELECT count(*) AS total, count(*) FILTER (event_time BETWEEN as_of - INTERVAL 24 HOUR AND as_of) AS in_window, max(event_time) AS latest, "
            "cast(floor((epoch_us(any_value(as_of)) - epoch_us(max(event_time))) / 1000000) as bigint) AS lag_seconds FROM alerts, p",
        ),
    }


def _stored(texts: str = "coalesce({c}, '')") -> str:
    text = {
        "event_type", "device_name", "device_ip", "category", "attack_function", "attack_step", "signature",
        "src_ip", "src_mac", "dst_ip", "dst_mac", "protocol",
    }
    return ", ".join(f"{texts.format(c=c)} AS {c}" if c in text else c for c in ALERT_COLUMNS)


def _baseline_candidates(v: Views) -> DataFrame:
    return sinks.baseline_rows(filters.exclude_categories(v.alerts), "2024-02-01 02:00:00")


_CANDIDATES = (
    f"cand AS (SELECT {_stored()}, TIMESTAMP '2024-02-01 02:00:00' AS added_to_baseline_at FROM alerts "
    "WHERE category NOT IN ('严重漏洞', '勒索软件', '数据泄露'))"
)


def _inserted(v: Views, stored: DataFrame, candidates: DataFrame, schema: T.StructType) -> DataFrame:
    """The table as it stands after the stored rows and, twice, the candidates were added to it."""
    path = scratch_path(v.spark, "insert")
    for rows in (stored, candidates, candidates):
        sinks.append_new(path, rows, schema)
    return sinks.read_or_empty(v.spark, path, schema)


def _zero_day_candidates(v: Views) -> DataFrame:
    return sinks.zero_day_rows(v.alerts.where("threat_level = 40").withColumn("zero_day_score", F.round(F.col("bytes_to_client") / 10000, 6)))


_ZD_CANDIDATES = f"cand AS (SELECT {ALL}, round(bytes_to_client / 10000e0, 6) AS zero_day_score FROM alerts WHERE threat_level = 40)"


def _csv_roundtrip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "report")
    report = agg.value_counts(v.alerts, "category")
    sinks.csv_report(report, path)
    return v.spark.read.option("header", True).schema("category string, n long").csv(path)


def _updates(v: Views) -> DataFrame:
    """State entries a detection run leaves: one per zero-day alert."""
    return v.zero_day.select(
        F.lit("last_zero_day_detection_update").alias("config_key"),
        F.date_format("created_at", timeparts.FULL_FORMAT).alias("config_value"),
        F.expr("created_at + INTERVAL '90' DAY").alias("last_updated"),
        F.col("id").alias("entry_id"),
    )


_STATE = (
    "state AS (SELECT config_key, arg_max(config_value, (last_updated, entry_id)) AS config_value, max(last_updated) AS last_updated FROM state_log GROUP BY config_key)"
)
COMPONENTS = ["baseline_data", "baseline_model", "zero_day_model", "zero_day_detection"]


def _sinks() -> dict[str, Query]:
    return {
        "project_storage_columns": checked(
            lambda v: sinks.project_storage_columns(v.zero_day), f"SELECT {_stored()} FROM zero_day_alerts"
        ),
        "baseline_insert_new": checked(
            lambda v: _inserted(v, v.baseline, _baseline_candidates(v), BASELINE_SCHEMA),
            f"SELECT {ALL}, added_to_baseline_at FROM baseline_alerts UNION ALL SELECT {ALL}, added_to_baseline_at FROM cand WHERE id NOT IN (SELECT id FROM baseline_alerts)",
            _CANDIDATES,
        ),
        "baseline_insert_counts": checked(
            lambda v: sinks.insert_counts(v.baseline, _baseline_candidates(v)),
            "SELECT count(*) AS sent, count(*) FILTER (id NOT IN (SELECT id FROM baseline_alerts)) AS inserted, count(*) FILTER (id IN (SELECT id FROM baseline_alerts)) AS skipped FROM cand",
            _CANDIDATES,
        ),
        "zeroday_insert_new": checked(
            lambda v: _inserted(v, v.zero_day, _zero_day_candidates(v), ZERO_DAY_SCHEMA),
            f"SELECT {ALL}, zero_day_score FROM zero_day_alerts UNION ALL SELECT {ALL}, zero_day_score FROM cand WHERE id NOT IN (SELECT id FROM zero_day_alerts)",
            _ZD_CANDIDATES,
        ),
        "add_score_column": checked(
            lambda v: sinks.with_zero_day_score(v.alerts), f"SELECT {ALL}, 0.0e0 AS zero_day_score FROM alerts"
        ),
        "state_get": checked(
            lambda v: sinks.state_get(v.state_log, ["last_baseline_data_update", "last_zero_day_detection_update", "last_report"], "none"),
            "SELECT k AS config_key, coalesce(config_value, 'none') AS config_value FROM (VALUES ('last_baseline_data_update'), ('last_zero_day_detection_update'), ('last_report')) q(k) LEFT JOIN state ON config_key = k",
            _STATE,
        ),
        "state_upsert": checked(
            lambda v: sinks.state_upsert(v.state_log, _updates(v)),
            "SELECT config_key, arg_max(config_value, (last_updated, entry_id)) AS config_value, max(last_updated) AS last_updated FROM (SELECT * FROM state_log UNION ALL "
            "SELECT 'last_zero_day_detection_update', strftime(created_at, '%Y-%m-%d %H:%M:%S'), created_at + INTERVAL 90 DAY, id FROM zero_day_alerts) GROUP BY config_key",
        ),
        "last_update_times": checked(
            lambda v: sinks.last_update_times(v.state_log, COMPONENTS),
            "SELECT replace(replace(config_key, 'last_', ''), '_update', '') AS component, try_strptime(config_value, '%Y-%m-%d %H:%M:%S') AS last_update, "
            "strftime(try_strptime(config_value, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS last_update_text FROM state",
            _STATE,
        ),
        "csv_reports": checked(_csv_roundtrip, "SELECT category, count(*) AS n FROM alerts GROUP BY category"),
    }


_DETAIL_TEXT = ["category", "src_ip", "dst_ip", "signature", "protocol", "device_name", "device_ip", "attack_function", "attack_step", "src_mac", "dst_mac"]
DETAIL_SQL = (
    "id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, "
    + ", ".join(_DETAIL_TEXT)
    + ", src_port, dst_port, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("packets_to_server", "packets_to_client", "bytes_to_server", "bytes_to_client"))
    + ", coalesce(zero_day_score, 0) AS zero_day_score"
)


def _raw_numbers(v: Views) -> DataFrame:
    """Numbers as text with unreadable entries, as a text source would give."""
    port = F.when(F.col("threat_level") == 10, "abc").when(F.col("threat_level") == 20, F.concat(F.col("src_port").cast("string"), F.lit(".5")))
    return v.alerts.select(
        "id",
        port.otherwise(F.col("src_port").cast("string")).alias("src_port"),
        F.col("dst_port").cast("string").alias("dst_port"),
        F.when(F.col("protocol") == "UDP", "").otherwise(F.col("packets_to_server").cast("string")).alias("packets_to_server"),
        "bytes_to_server",
    )


def _filters() -> dict[str, Query]:
    return {
        "recent_by_created": checked(
            lambda v: filters.recent_by_created(v.alerts, CHART_DAYS, v.as_of),
            f"SELECT {ALL} FROM alerts, p WHERE created_at >= as_of - INTERVAL 7 DAY",
        ),
        "exclude_categories": checked(
            lambda v: filters.exclude_categories(v.alerts), f"SELECT {ALL} FROM alerts WHERE category NOT IN ('严重漏洞', '勒索软件', '数据泄露')"
        ),
        "created_date_range": checked(
            lambda v: filters.created_date_range(v.zero_day, "2023-12-20", "2024-01-15"),
            f"SELECT {ALL}, zero_day_score FROM zero_day_alerts WHERE cast(created_at as date) BETWEEN DATE '2023-12-20' AND DATE '2024-01-15'",
        ),
        "fill_missing": checked(
            lambda v: traffic.fill_missing(v.alerts),
            "SELECT "
            + ", ".join(
                f"coalesce({c}, 'unknown') AS {c}"
                if c in ("protocol", "event_type", "category", "attack_function", "attack_step", "signature")
                else (f"coalesce({c}, 0) AS {c}" if c in ("threat_level", "packets_to_server", "packets_to_client", "bytes_to_server", "bytes_to_client") else c)
                for c in ALERT_COLUMNS
            )
            + " FROM alerts",
        ),
        "coerce_numeric": checked(
            lambda v: traffic.coerce_numeric(_raw_numbers(v)),
            "SELECT id, coalesce(try_cast(s as double), 0) AS src_port, coalesce(try_cast(d as double), 0) AS dst_port, coalesce(try_cast(t as double), 0) AS packets_to_server, coalesce(bytes_to_server, 0) AS bytes_to_server FROM raw",
            "raw AS (SELECT id, CASE threat_level WHEN 10 THEN 'abc' WHEN 20 THEN concat(cast(src_port as varchar), '.5') ELSE cast(src_port as varchar) END AS s, "
            "cast(dst_port as varchar) AS d, CASE WHEN protocol = 'UDP' THEN '' ELSE cast(packets_to_server as varchar) END AS t, bytes_to_server FROM alerts)",
        ),
        "zero_day_detail": checked(lambda v: filters.zero_day_detail(v.zero_day), f"SELECT {DETAIL_SQL} FROM zero_day_alerts"),
        "drop_score_columns": checked(
            lambda v: filters.drop_score_columns(v.zero_day.withColumns({"is_anomaly": F.lit(True), "anomaly_score": F.lit(0.1), "kmeans_score": F.lit(0.2)})),
            f"SELECT {ALL}, zero_day_score FROM zero_day_alerts",
        ),
        "threat_band": checked(
            lambda v: v.alerts.groupBy("threat_level", traffic.threat_band(F.col("threat_level")).alias("band")).agg(F.count(F.lit(1)).alias("n")),
            "SELECT threat_level, CASE WHEN threat_level >= 30 THEN '高危' WHEN threat_level >= 20 THEN '中危' ELSE '低危' END AS band, count(*) AS n FROM alerts GROUP BY ALL",
        ),
        "has_cjk": checked(
            lambda v: traffic.has_cjk(v.alerts),
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, coalesce(bool_or(regexp_matches({c}, '[一-鿿]')), false) AS has_cjk FROM alerts"
                for c in ("event_type", "device_name", "device_ip", "category", "attack_function", "attack_step", "signature", "src_ip", "src_mac", "dst_ip", "dst_mac", "protocol")
            ),
        ),
    }


def _joins() -> dict[str, Query]:
    return {
        "anti_existing_ids": checked(
            lambda v: joins.anti_existing_ids(v.alerts, v.baseline).select(*ALERT_COLUMNS),
            f"SELECT {ALL} FROM alerts WHERE id NOT IN (SELECT id FROM baseline_alerts)",
        ),
        "id_overlap": checked(
            lambda v: joins.id_overlap(scans.detection_window(v.alerts, 7 * 24, v.as_of_event), scans.detection_window(v.zero_day, 7 * 24, v.as_of_event)),
            "SELECT (SELECT count(*) FROM a) AS alert_ids, (SELECT count(*) FROM z) AS zero_day_ids, (SELECT count(*) FROM a JOIN z USING (id)) AS overlap_ids, "
            "(SELECT min(id) FROM a) AS alert_min_id, (SELECT max(id) FROM a) AS alert_max_id, (SELECT min(id) FROM z) AS zero_day_min_id, (SELECT max(id) FROM z) AS zero_day_max_id",
            "a AS (SELECT DISTINCT id FROM alerts, p WHERE event_time BETWEEN as_of_event - INTERVAL 7 DAY AND as_of_event), "
            "z AS (SELECT DISTINCT id FROM zero_day_alerts, p WHERE event_time BETWEEN as_of_event - INTERVAL 7 DAY AND as_of_event)",
        ),
        "zeroday_in_alerts": checked(
            lambda v: joins.present_in(v.zero_day, v.alerts).select("id", "event_time", "zero_day_score"),
            "SELECT id, event_time, zero_day_score FROM zero_day_alerts WHERE id IN (SELECT id FROM alerts)",
        ),
        "zeroday_not_in_alerts": checked(
            lambda v: joins.anti_existing_ids(v.zero_day, v.alerts).select("id", "event_time", "zero_day_score"),
            "SELECT id, event_time, zero_day_score FROM zero_day_alerts WHERE id NOT IN (SELECT id FROM alerts)",
        ),
        "score_lookup": checked(
            lambda v: joins.score_lookup(scans.detection_window(v.alerts, 7 * 24, v.as_of_event), v.zero_day).select("id", "event_time", "zero_day_score"),
            "SELECT a.id, a.event_time, z.zero_day_score FROM alerts a CROSS JOIN p LEFT JOIN zero_day_alerts z USING (id) WHERE a.event_time BETWEEN as_of_event - INTERVAL 7 DAY AND as_of_event",
        ),
        "internal_membership": checked(
            lambda v: joins.internal_membership(v.alerts, "src_ip", scans.internal_ip_list(v.internal_ips)).select("id", "src_ip", "src_ip_is_internal"),
            "SELECT id, src_ip, CASE WHEN ip_address IS NULL THEN 0 ELSE 1 END AS src_ip_is_internal FROM alerts LEFT JOIN ip_address ON src_ip = ip_address",
        ),
        "date_spine_join": checked(
            lambda v: agg.date_spine_join(v.alerts, v.baseline, v.zero_day, 14, v.as_of), _SPINE_SELECT, _spine(14)
        ),
        "intersect_ids": checked(
            lambda v: joins.intersect_ids(v.alerts, v.zero_day), "SELECT id FROM alerts INTERSECT SELECT id FROM zero_day_alerts"
        ),
        "except_ids": checked(lambda v: joins.except_ids(v.alerts, v.baseline), "SELECT id FROM alerts EXCEPT SELECT id FROM baseline_alerts"),
    }


def _spine(days: int) -> str:
    def daily(table: str) -> str:
        return f"(SELECT cast(created_at as date) AS d, count(*) AS n FROM {table}, p WHERE created_at >= as_of - INTERVAL {days} DAY GROUP BY 1)"

    return (
        f"spine AS (SELECT cast(unnest(generate_series(cast(as_of as date) - {days}, cast(as_of as date), INTERVAL 1 DAY)) as date) AS date FROM p), "
        "joined AS (SELECT date, coalesce(t.n, 0) AS total, coalesce(b.n, 0) AS baseline, coalesce(z.n, 0) AS zero_day FROM spine "
        f"LEFT JOIN {daily('alerts')} t ON t.d = date LEFT JOIN {daily('baseline_alerts')} b ON b.d = date LEFT JOIN {daily('zero_day_alerts')} z ON z.d = date)"
    )


_SPINE_SELECT = "SELECT date, total, baseline, zero_day FROM joined"
_COMPARISON = (
    "SELECT strftime(date, '%m-%d') AS label, date, total, greatest(0, total - baseline) AS anomalous, zero_day FROM joined "
    "WHERE (SELECT sum(total + zero_day) FROM joined) > 0"
)
_DAILY_CREATED = (
    "SELECT strftime(created_at, '%m-%d') AS label, cast(created_at as date) AS date, count(*) AS n FROM alerts, p "
    "WHERE created_at >= as_of - INTERVAL 7 DAY GROUP BY ALL"
)
_HEATMAP = (
    "SELECT *, (SELECT max(n) FROM cells) AS max_count FROM cells",
    "cells AS (SELECT cast(isodow(created_at) - 1 as int) AS day_of_week, cast(hour(created_at) as int) AS hour_of_day, count(*) AS n "
    "FROM zero_day_alerts, p WHERE created_at >= as_of - INTERVAL 30 DAY GROUP BY 1, 2)",
)
_PROFILE = ["category", "event_type", "signature", "src_ip", "dst_ip"]
_DISTINCT = ", ".join(f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {{p}}{c}" for c in _PROFILE)
_RANGES = (
    "min(event_time) AS event_time_min, max(event_time) AS event_time_max, min(created_at) AS created_at_min, max(created_at) AS created_at_max"
)


def _aggregates() -> dict[str, Query]:
    return {
        "count_tables": checked(
            lambda v: agg.count_tables(v.baseline, v.zero_day, v.alerts),
            "SELECT (SELECT count(*) FROM baseline_alerts) AS baseline_count, (SELECT count(*) FROM zero_day_alerts) AS zero_day_count, (SELECT count(*) FROM alerts) AS alert_count",
        ),
        "daily_alerts_event": checked(
            lambda v: agg.daily_counts(v.alerts, "event_time", 30, v.as_of_event),
            "SELECT cast(event_time as date) AS date, count(*) AS n FROM alerts, p WHERE event_time >= as_of_event - INTERVAL 30 DAY GROUP BY 1",
        ),
        "daily_alerts_created": checked(lambda v: agg.daily_alerts_created(v.alerts, v.as_of, CHART_DAYS), _DAILY_CREATED),
        "category_counts": checked(
            lambda v: agg.value_counts(v.zero_day, "category"), "SELECT category, count(*) AS n FROM zero_day_alerts GROUP BY category"
        ),
        "category_distribution": checked(
            lambda v: agg.value_counts(filters.recent_by_created(v.zero_day, CHART_DAYS, v.as_of), "category", "name").withColumnRenamed("n", "value"),
            "SELECT category AS name, count(*) AS value FROM zero_day_alerts, p WHERE created_at >= as_of - INTERVAL 7 DAY GROUP BY category",
        ),
        "top_source_ips": checked(
            lambda v: agg.top_values(v.zero_day, "src_ip", 10),
            "SELECT src_ip, count(*) AS n FROM zero_day_alerts GROUP BY src_ip ORDER BY n DESC, src_ip NULLS LAST LIMIT 10",
        ),
        "ip_attack_stats": checked(
            lambda v: agg.top_values(filters.recent_by_created(v.zero_day, 14, v.as_of), "src_ip", 10, "source_ip"),
            "SELECT src_ip AS source_ip, count(*) AS n FROM zero_day_alerts, p WHERE created_at >= as_of - INTERVAL 14 DAY GROUP BY src_ip ORDER BY n DESC, src_ip NULLS LAST LIMIT 10",
        ),
        "monthly_trend": checked(
            lambda v: agg.monthly_trend(v.zero_day),
            "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM zero_day_alerts GROUP BY 1",
        ),
        "time_heatmap": checked(lambda v: agg.time_heatmap(v.zero_day, 30, v.as_of), *_HEATMAP),
        "daily_comparison": checked(
            lambda v: agg.daily_comparison(v.alerts, v.baseline, v.zero_day, CHART_DAYS, v.as_of), _COMPARISON, _spine(CHART_DAYS)
        ),
        "value_frequency": checked(
            lambda v: value_frequency(v.alerts, ["event_type", "category", "src_ip", "attack_function", "attack_step", "signature"]).withColumn("freq", F.round("freq", 6)),
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, round(count(*) / cast((SELECT count({c}) FROM alerts) as double), 6) AS freq FROM alerts WHERE {c} IS NOT NULL GROUP BY {c}"
                for c in ("event_type", "category", "src_ip", "attack_function", "attack_step", "signature")
            ),
        ),
        "distinct_profile": checked(lambda v: agg.distinct_profile(v.alerts), f"SELECT {_DISTINCT.format(p='')} FROM alerts"),
        "time_range_profile": checked(lambda v: agg.time_range_profile(v.alerts), f"SELECT {_RANGES} FROM alerts"),
        "alert_overview": checked(
            lambda v: agg.alert_overview(v.alerts, v.as_of_event, DETECTION_HOURS),
            f"SELECT count(*) AS total, {_RANGES}, {_DISTINCT.format(p='n_')} FROM alerts, p WHERE event_time BETWEEN as_of_event - INTERVAL 24 HOUR AND as_of_event",
        ),
        "score_range": checked(
            lambda v: agg.score_range(v.zero_day), "SELECT min(zero_day_score) AS min_score, max(zero_day_score) AS max_score FROM zero_day_alerts"
        ),
        "dashboard_summary": checked(
            lambda v: agg.dashboard_summary(v.baseline, v.zero_day),
            "SELECT (SELECT count(*) FROM (SELECT DISTINCT category FROM zero_day_alerts)) AS n_categories, (SELECT least(10, count(*)) FROM (SELECT DISTINCT src_ip FROM zero_day_alerts)) AS n_top_ips, "
            "(SELECT count(*) FROM baseline_alerts) AS baseline_count, (SELECT count(*) FROM zero_day_alerts) AS zero_day_count",
        ),
        # Days are sketched once; exact quantiles of a window come from them and a counting pass.
        "window_quantiles": checked(
            lambda v: profiles.window_error_quantiles(v.events, materialise(profiles.daily_sketches(v.events, "ts", [], ["value"]), "day-sketches"), "value", "2024-01-05", "2024-01-19", "ts"),
            "SELECT min(value) AS min_value, max(value) AS max_value, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95 "
            "FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-20'",
        ),
        "window_profile": checked(
            _window_profile,
            "SELECT count(*) AS rows, " + ", ".join(f"true AS {c}" for c in agg.PROFILE_COLUMNS) + " FROM alerts WHERE event_time >= DATE '2024-01-05' AND event_time < DATE '2024-01-20'",
        ),
        "error_quantiles": checked(
            lambda v: quantiles.error_quantiles(v.events, "value").select(*[F.round(c, 6).alias(c) for c in ("min_value", "max_value", "q25", "q50", "q75", "q95")]),
            "SELECT round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, "
            + ", ".join(f"round(quantile_cont(value, {f}), 6) AS {n}" for n, f in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95)))
            + " FROM events",
        ),
        "minmax_stats": checked(
            lambda v: scores.minmax_stats(v.alerts, ["bytes_to_server", "packets_to_server", "threat_level"]),
            "SELECT " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in ("bytes_to_server", "packets_to_server", "threat_level")) + " FROM alerts",
        ),
        "percentages": checked(
            lambda v: v.alerts.groupBy("category").agg(F.count_if(F.col("threat_level") >= 30).alias("high"), F.count(F.lit(1)).alias("total")).withColumn(
                "high_pct", scores.percentage(F.col("high"), F.col("total"))
            ),
            "SELECT category, count(*) FILTER (threat_level >= 30) AS high, count(*) AS total, round(100e0 * count(*) FILTER (threat_level >= 30) / greatest(count(*), 1), 2) AS high_pct FROM alerts GROUP BY category",
        ),
        "clamp": checked(
            lambda v: v.alerts.select("id", scores.clamp_difference(F.col("bytes_to_server"), F.col("bytes_to_client")).alias("excess")),
            "SELECT id, greatest(0, bytes_to_server - bytes_to_client) AS excess FROM alerts",
        ),
        "date_parts": checked(
            lambda v: v.alerts.select("id", *[c.alias(n) for n, c in timeparts.date_parts(F.col("created_at")).items()]),
            "SELECT id, cast(created_at as date) AS date, cast(year(created_at) as int) AS year, cast(month(created_at) as int) AS month, cast(isodow(created_at) - 1 as int) AS weekday, cast(hour(created_at) as int) AS hour FROM alerts",
        ),
        "date_formats": checked(
            lambda v: v.alerts.select("id", *[c.alias(n) for n, c in timeparts.date_texts(F.col("created_at")).items()]),
            "SELECT id, strftime(created_at, '%m-%d') AS month_day, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS \"full\", strftime(created_at, '%Y-%m-%d') AS day, strftime(created_at, '%Y-%m') AS month_key FROM alerts",
        ),
        "late_rows": checked(
            lambda v: agg.lateness(v.alerts, DETECTION_HOURS),
            "SELECT count(*) AS total, min(l) AS min_seconds, max(l) AS max_seconds, count(*) FILTER (l > 86400) AS beyond_lookback, count(*) FILTER (l > 1800) AS beyond_half_hour "
            "FROM (SELECT cast((epoch_us(created_at) - epoch_us(event_time)) // 1000000 as bigint) AS l FROM alerts)",
        ),
    }


_HISTORY_SQL = (
    f"SELECT {DETAIL_SQL}, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS detected_at, coalesce(threat_level, 0) AS threat_level FROM "
    "(SELECT * FROM zero_day_alerts WHERE cast(created_at as date) BETWEEN DATE '2023-12-01' AND DATE '2024-01-20' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20)"
)


_DEEP = ["id", "created_at", "threat_level", "src_ip"]


def _lists() -> dict[str, Query]:
    return {
        "history_page": checked(
            lambda v: topk.history_page(v.zero_day, "2023-12-01", "2024-01-20", page=2, page_size=20),
            f"SELECT {ALL}, zero_day_score FROM zero_day_alerts WHERE cast(created_at as date) BETWEEN DATE '2023-12-01' AND DATE '2024-01-20' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20",
        ),
        # The rank index is built and used, and stretches are cut down to a few rows.
        "history_deep_page": checked(
            lambda v: paging.history_deep_page(v.alerts.select(*_DEEP), page=21, page_size=37, stretch_rows=50),
            f"SELECT {', '.join(_DEEP)} FROM alerts ORDER BY created_at DESC NULLS LAST, id LIMIT 37 OFFSET 740",
        ),
        "history_totals": checked(
            lambda v: topk.history_totals(v.zero_day, "2023-12-01", "2024-01-20", 20),
            "SELECT count(*) AS total, cast(ceil(count(*) / 20e0) as bigint) AS pages FROM zero_day_alerts WHERE cast(created_at as date) BETWEEN DATE '2023-12-01' AND DATE '2024-01-20'",
        ),
        "history": checked(lambda v: topk.history(v.zero_day, start="2023-12-01", end="2024-01-20", page=2, page_size=20), _HISTORY_SQL),
        "kth_smallest": checked(
            lambda v: v.spark.createDataFrame([(quantiles.kth_smallest(v.alerts, "bytes_to_server", 0.05),)], "kth bigint"),
            "SELECT bytes_to_server AS kth FROM alerts ORDER BY 1 LIMIT 1 OFFSET (SELECT cast(floor(count(*) * 0.05e0) as bigint) FROM alerts)",
        ),
        "latest_zero_days": checked(
            lambda v: topk.latest_zero_days(v.zero_day, 10),
            "SELECT id, event_time, category, src_ip, dst_ip, zero_day_score, created_at FROM zero_day_alerts ORDER BY created_at DESC, id LIMIT 10",
        ),
    }


_TOP_IPS = "SELECT src_ip, count(*) AS n FROM zero_day_alerts GROUP BY src_ip ORDER BY n DESC, src_ip NULLS LAST LIMIT 10"


def _dashboards() -> dict[str, Query]:
    return {
        "stats": checked(
            lambda v: dashboards.stats_rows(v.alerts, v.baseline, v.zero_day, v.as_of_event),
            "SELECT 'baseline_count' AS section, cast(null as varchar) AS name, count(*) AS n FROM baseline_alerts "
            "UNION ALL SELECT 'zeroday_count', null, count(*) FROM zero_day_alerts "
            "UNION ALL SELECT 'daily_alerts', strftime(event_time, '%Y-%m-%d'), count(*) FROM alerts, p WHERE event_time >= as_of_event - INTERVAL 30 DAY GROUP BY 2 "
            "UNION ALL SELECT 'categories', category, count(*) FROM zero_day_alerts GROUP BY category "
            f"UNION ALL SELECT 'top_source_ips', src_ip, n FROM ({_TOP_IPS}) "
            "UNION ALL SELECT 'monthly_trend', strftime(created_at, '%Y-%m'), count(*) FROM zero_day_alerts GROUP BY 2",
        ),
        "charts": checked(
            lambda v: dashboards.chart_points(v.alerts, v.baseline, v.zero_day, v.as_of, days=7, limit=10),
            "SELECT 'daily_alerts' AS chart, strftime(created_at, '%m-%d') AS x, '告警数量' AS series, count(*) AS value FROM alerts, p WHERE created_at >= as_of - INTERVAL 7 DAY GROUP BY cast(created_at as date), 2 "
            "UNION ALL SELECT 'category_distribution', category, '零日攻击', count(*) FROM zero_day_alerts, p WHERE created_at >= as_of - INTERVAL 7 DAY GROUP BY category "
            "UNION ALL SELECT 'time_heatmap', concat(lpad(cast(hour(created_at) as varchar), 2, '0'), ':00'), CASE isodow(created_at) WHEN 1 THEN '周一' WHEN 2 THEN '周二' WHEN 3 THEN '周三' WHEN 4 THEN '周四' WHEN 5 THEN '周五' WHEN 6 THEN '周六' ELSE '周日' END, count(*) "
            "FROM zero_day_alerts, p WHERE created_at >= as_of - INTERVAL 7 DAY GROUP BY 2, 3 "
            "UNION ALL SELECT 'ip_attack_stats', src_ip, '攻击次数', n FROM (SELECT src_ip, count(*) AS n FROM zero_day_alerts, p WHERE created_at >= as_of - INTERVAL 7 DAY GROUP BY src_ip ORDER BY n DESC, src_ip NULLS LAST LIMIT 10) "
            "UNION ALL SELECT 'daily_alert_comparison', strftime(date, '%m-%d'), '总告警数量', total FROM joined "
            "UNION ALL SELECT 'daily_alert_comparison', strftime(date, '%m-%d'), '异常告警数量', greatest(0, total - baseline) FROM joined "
            "UNION ALL SELECT 'daily_alert_comparison', strftime(date, '%m-%d'), '零日告警数量', zero_day FROM joined",
            _spine(7),
        ),
        "versions": checked(
            lambda v: dashboards.versions(v.state_log, v.baseline, v.zero_day),
            "SELECT CASE component WHEN 'zero_day_detection' THEN 'last_detection' ELSE component END AS component, strftime(t, '%Y-%m-%d %H:%M:%S') AS last_update, "
            "CASE component WHEN 'baseline_data' THEN (SELECT count(*) FROM baseline_alerts) WHEN 'zero_day_detection' THEN (SELECT count(*) FROM zero_day_alerts) END AS n FROM "
            "(SELECT replace(replace(config_key, 'last_', ''), '_update', '') AS component, try_strptime(config_value, '%Y-%m-%d %H:%M:%S') AS t FROM state)",
            _STATE,
        ),
    }


def queries() -> dict[str, Query]:
    return {**_scans(), **_sinks(), **_filters(), **_joins(), **_aggregates(), **_lists(), **_dashboards()}

