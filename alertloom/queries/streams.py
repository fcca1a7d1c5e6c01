"""Registered queries: streams over the events file, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.models.scorer import ModelSet, add_raw_scores
from alertloom.operators.sinks import read_or_empty
from alertloom.plans.baseline import baseline_candidates
from alertloom.plans.train import with_frozen_ranges
from alertloom.queries import scoring
from alertloom.queries.registry import Query, checked
from alertloom.queries.relational import ALL
from alertloom.schemas import BASELINE_SCHEMA, STATE_SCHEMA, ZERO_DAY_SCHEMA
from alertloom.sources.views import Views, alerts_from_events
from alertloom.storage import materialise, scratch_path
from alertloom.streaming import jobs


def _stream(v: Views) -> DataFrame:
    return alerts_from_events(jobs.table_stream(v.spark, f"{v.sf_dir}/events.parquet", v.events.schema))


def _frozen(rows: DataFrame, models: ModelSet) -> ModelSet:
    raw = materialise(add_raw_scores(models.encode(rows), models).select("id", "if_raw", "km_raw", "err"), "ranges")
    return with_frozen_ranges(models, raw)


def _paths(v: Views, label: str) -> tuple[str, str]:
    return scratch_path(v.spark, f"{label}-out"), scratch_path(v.spark, f"{label}-progress")


def _detect(v: Views) -> DataFrame:
    path, progress = _paths(v, "stream-detect")
    models = _frozen(v.alerts, scoring.with_threshold(v))
    jobs.stream_detect(_stream(v), models, path, progress)
    return read_or_empty(v.spark, path, ZERO_DAY_SCHEMA).withColumn("zero_day_score", F.round("zero_day_score", 6))


def _dedupe(v: Views) -> DataFrame:
    path, progress = _paths(v, "stream-dedupe")
    doubled = _stream(v).unionByName(_stream(v))
    out = jobs.dedupe(doubled).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    jobs.append_files(out, path, progress)
    return v.spark.read.schema(out.schema).parquet(path).select("id", "event_time", "category", "src_ip")


def _counts(v: Views, label: str, counts: DataFrame, *keys: str) -> DataFrame:
    path, progress = _paths(v, label)
    jobs.follow_counts(counts, path, progress)
    return jobs.current_counts(v.spark, path, counts.schema, list(keys))


def _baseline(v: Views) -> DataFrame:
    path, progress = _paths(v, "stream-baseline")
    state = scratch_path(v.spark, "stream-state")
    nothing = v.spark.createDataFrame([], BASELINE_SCHEMA)
    models = _frozen(baseline_candidates(v.alerts, nothing, v.as_of), scoring.fixed_models())
    jobs.stream_baseline_update(_stream(v), models, path, state, progress, v.as_of)
    logged = v.spark.read.schema(STATE_SCHEMA).parquet(state).agg(F.max("config_value")).scalar()
    rows = v.spark.read.schema(BASELINE_SCHEMA).parquet(path)
    return rows.select("id", "category", "protocol", "dst_port").withColumn("last_update", logged)


def _late(v: Views) -> DataFrame:
    """Alerts per day from a stream of eight files, what came in time and what came too late together."""
    source, (path, progress) = scratch_path(v.spark, "event-files"), _paths(v, "stream-late")
    v.events.repartition(8, F.xxhash64("event_id")).write.parquet(source)
    stream = alerts_from_events(jobs.file_stream(v.spark, source, v.events.schema, files_per_batch=1))
    jobs.follow_windows(stream, path, progress, lateness="3 days")
    counted = jobs.counted_windows(v.spark, path).select("window_start", "n")
    late = jobs.late_rows(v.spark, path, stream.schema).groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))
    return counted.union(late).groupBy(F.to_date("window_start").alias("date")).agg(F.sum("n").alias("n"))


def queries() -> dict[str, Query]:
    return {
        "stream_detect": checked(_detect, f"SELECT {ALL}, round(zs, 6) AS zero_day_score FROM det WHERE zd", scoring.FIXED),
        "stream_dedupe": checked(_dedupe, "SELECT DISTINCT id, event_time, category, src_ip FROM alerts"),
        "stream_daily_counts": checked(
            lambda v: _counts(v, "stream-daily", jobs.daily_counts(_stream(v)), "date"), "SELECT cast(event_time as date) AS date, count(*) AS n FROM alerts GROUP BY 1"
        ),
        "stream_late_rows": checked(_late, "SELECT cast(event_time as date) AS date, count(*) AS n FROM alerts GROUP BY 1"),
        "stream_sliding_24h": checked(
            lambda v: _counts(v, "stream-sliding", jobs.sliding_counts(_stream(v)), "window_start", "window_end"),
            "SELECT s AS window_start, s + INTERVAL 24 HOUR AS window_end, count(*) AS n FROM (SELECT unnest(list_transform(range(12), lambda i: time_bucket(INTERVAL 2 HOUR, event_time) - to_hours(2 * i))) AS s FROM alerts) GROUP BY s",
        ),
        "stream_baseline_update": checked(
            _baseline,
            "SELECT id, category, coalesce(protocol, 'unknown') AS protocol, coalesce(dst_port, 0) AS dst_port, (SELECT strftime(as_of, '%Y-%m-%d %H:%M:%S') FROM p) AS last_update FROM cls WHERE NOT anomaly",
            "cand_in AS (SELECT alerts.* FROM alerts, p WHERE created_at >= as_of - INTERVAL 30 DAY AND category NOT IN ('严重漏洞', '勒索软件', '数据泄露')), "
            + scoring.fixed_ctes("cand_in"),
        ),
    }
