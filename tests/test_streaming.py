from __future__ import annotations

import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from alertloom.models import store
from alertloom.plans import detect, train
from alertloom.plans.preprocess import engineer, frequency_table
from alertloom.plans.train import with_frozen_ranges
from alertloom.queries import literal, scoring
from alertloom.schemas import ZERO_DAY_SCHEMA
from alertloom.sources.views import alerts_from_events
from alertloom.storage import scratch_path
from alertloom.streaming import jobs
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, views):
    """The events in five files, so that a stream has several batches."""
    path = scratch_path(spark, "events")
    views.events.repartitionByRange(5, "event_id").write.parquet(path)
    return path


def stream(spark, views, folder, files=1):
    return alerts_from_events(jobs.file_stream(spark, folder, views.events.schema, files_per_batch=files))


@pytest.fixture(scope="module")
def models(views):
    models = scoring.with_threshold(views)
    raw = detect.score_raw_alerts(views.alerts, models)
    return with_frozen_ranges(models, raw)


def test_detection_in_batches_equals_one_batch(spark, views, folder, models):
    path, progress = scratch_path(spark, "out"), scratch_path(spark, "progress")
    jobs.stream_detect(stream(spark, views, folder), models, path, progress)
    got = {r.id: round(r.zero_day_score, 6) for r in spark.read.schema(ZERO_DAY_SCHEMA).parquet(path).collect()}
    batch = detect.detect_zero_day(views.alerts, models).where("is_zero_day")
    assert got == {r.id: round(r.zero_day_score, 6) for r in batch.collect()}
    # Replayed from the start: the sink adds nothing.
    jobs.stream_detect(stream(spark, views, folder, files=3), models, path, scratch_path(spark, "progress"))
    assert spark.read.parquet(path).count() == len(got)


def test_streams_need_frozen_ranges(spark, views, folder):
    with pytest.raises(ValueError, match="frozen"):
        jobs.stream_detect(stream(spark, views, folder), literal.literal_models(1.0), "unused", "unused")


def test_counts_over_several_batches(spark, views, folder):
    path, counts = scratch_path(spark, "daily"), jobs.daily_counts(stream(spark, views, folder), lateness="60 days")
    assert jobs.follow_counts(counts, path, scratch_path(spark, "progress")) == 0
    got = {r.date: r.n for r in jobs.current_counts(spark, path, counts.schema, ["date"]).collect()}
    want = {r.date: r["count"] for r in views.alerts.selectExpr("to_date(event_time) AS date").groupBy("date").count().collect()}
    assert got == want


def test_late_rows_are_left_out_and_counted(spark, views):
    source, path, progress = (scratch_path(spark, n) for n in ("source", "daily", "progress"))
    late, rest = "ts < '2024-01-10'", "ts >= '2024-01-20'"
    views.events.where(rest).write.parquet(source)
    counts = jobs.daily_counts(stream(spark, views, source), lateness="2 days")
    jobs.follow_counts(counts, path, progress)
    views.events.where(late).write.mode("append").parquet(source)
    views.events.where(rest).limit(1).write.mode("append").parquet(source)
    lost = jobs.follow_counts(jobs.daily_counts(stream(spark, views, source, files=100), lateness="2 days"), path, progress)
    days = {r.date.isoformat() for r in jobs.current_counts(spark, path, counts.schema, ["date"]).collect()}
    assert lost > 0 and min(days) >= "2024-01-20"


def test_scores_with_frequencies_do_not_depend_on_batches(spark, views, folder):
    """A model that reads a frequency and nothing else: batch and stream agree, cut as they may."""
    frequencies = frequency_table(views.alerts)

    def columns(alerts):
        return {r.id: r.src_ip_freq for r in engineer(alerts, frozen=frequencies).collect()}

    whole = columns(views.alerts)
    parts = [columns(views.alerts.where(f"id % 5 = {k}")) for k in range(5)]
    assert {i: x for part in parts for i, x in part.items()} == whole
    assert whole == {r.id: r.src_ip_freq for r in engineer(views.alerts).collect()}


def test_resumed_stream_reads_only_new_files(spark, views):
    source, path, progress = (scratch_path(spark, n) for n in ("source", "dedupe", "progress"))
    views.events.where("event_id < 500").write.parquet(source)
    jobs.append_files(jobs.dedupe(stream(spark, views, source)), path, progress)
    first = spark.read.parquet(path).count()
    views.events.where("event_id BETWEEN 490 AND 600").write.mode("append").parquet(source)
    jobs.append_files(jobs.dedupe(stream(spark, views, source)), path, progress)
    assert first == 500 and spark.read.parquet(path).count() == 601


def test_a_single_file_is_a_stream_too(spark, views):
    path = scratch_path(spark, "single")
    events = jobs.table_stream(spark, f"{views.sf_dir}/events.parquet", views.events.schema)
    jobs.append_files(alerts_from_events(events).select("id"), path, scratch_path(spark, "progress"))
    assert spark.read.parquet(path).count() == views.events.count()


def test_baseline_update_logs_its_state(spark, views, folder, models):
    path, state, progress = (scratch_path(spark, n) for n in ("base", "state", "progress"))
    jobs.stream_baseline_update(stream(spark, views, folder), models, path, state, progress, views.as_of)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("id").distinct().count() > 0
    assert {r.config_key for r in spark.read.parquet(state).collect()} == {"last_baseline_data_update"}


def test_late_rows_of_many_batches_are_kept(spark):
    """150 micro-batches, over the 100 reports that a query keeps by itself: counts and late
    rows equal the batch result, by the watermark rule worked out in plain code."""
    source, path = scratch_path(spark, "many"), scratch_path(spark, "windows")
    start = datetime(2024, 3, 1)
    draw = random.Random(4)
    rows = [(i, start + timedelta(minutes=20 * (i // 4) - (draw.randint(0, 4_000) if draw.random() < 0.3 else 0)), i // 4) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, event_time timestamp_ntz, file int")
    df.repartitionById(150, F.col("file")).write.parquet(source)
    # Files come in the order of their times of writing: here that of their numbers.
    for path_of, number in ((Path(f), int(f.name.split("-")[1])) for f in Path(source).glob("part-*.parquet")):
        os.utime(path_of, (1_700_000_000 + number, 1_700_000_000 + number))
    schema = df.schema
    jobs.follow_windows(jobs.file_stream(spark, source, schema, files_per_batch=1), path, scratch_path(spark, "progress"), lateness="12 hours")
    late = {r.id: r.batch for r in jobs.late_rows(spark, path, schema).collect()}
    counted = {r.window_start.date(): r.n for r in jobs.counted_windows(spark, path).collect()}
    order = {r.batch: r.file for r in spark.read.parquet(path).where("kind = 'late'").select("batch", "alert.file").distinct().collect()}
    assert spark.read.parquet(path).select("batch").distinct().count() == 150
    assert all(batch == file for batch, file in order.items())
    want_late, want, latest = set(), {}, None
    for file in range(150):
        own = [r for r in rows if r[2] == file]
        for i, t, _ in own:
            end = datetime(t.year, t.month, t.day) + timedelta(days=1)
            if latest is not None and end <= latest - timedelta(hours=12):
                want_late.add(i)
            else:
                want[t.date()] = want.get(t.date(), 0) + 1
        latest = max([r[1] for r in own] + ([latest] if latest else []))
    assert set(late) == want_late and len(late) > 20 and counted == want


def test_stored_training_starts_a_stream(spark, folder, views):
    """Train, store, load, stream: what the stream saves is what one batch gives."""
    path, state = scratch_path(spark, "models"), scratch_path(spark, "state")
    first = train.run_baseline_training(views.alerts, None, path, state, views.as_of_event, k=3, trees=10)
    train.run_zero_day_training(views.baseline, first.models, path, state, views.as_of_event, epochs=2)
    loaded = store.load_models(spark, path, need=("encoder", "forest", "clusters", "autoencoder", "frequencies"))
    assert [r.number for r in store.versions(spark, path).orderBy("number").collect()] == [1, 2] and set(loaded.flag_thresholds) == {"isolation_forest", "kmeans"}
    out = scratch_path(spark, "out")
    jobs.stream_detect(stream(spark, views, folder, files=2), loaded, out, scratch_path(spark, "progress"))
    got = {r.id: round(r.zero_day_score, 6) for r in spark.read.schema(ZERO_DAY_SCHEMA).parquet(out).collect()}
    batch = detect.detect_zero_day(views.alerts, loaded).where("is_zero_day")
    assert got == {r.id: round(r.zero_day_score, 6) for r in batch.collect()} and got
