"""What the optimiser makes of the operators: pushdown, pruning, map-side limits."""

from __future__ import annotations

import contextlib
import io

import pytest
from alertloom.operators import aggregates as agg
from alertloom.operators import filters, sinks, topk
from alertloom.sources import scans
from alertloom.storage import materialise, scratch_path


def explain(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def table(views):
    return materialise(views.alerts, "alerts")


def test_time_window_reaches_the_scan(table):
    plan = explain(filters.recent_by_created(table, 7, "2024-01-30 00:00:00").select("id"))
    assert "GreaterThanOrEqual(created_at,2024-01-23T00:00)" in plan
    assert "ReadSchema: struct<id:bigint,created_at:timestamp_ntz>" in plan


def test_date_range_reaches_the_scan(table):
    plan = explain(filters.created_date_range(table, "2024-01-02", "2024-01-03"))
    assert "GreaterThanOrEqual(created_at,2024-01-02T00:00)" in plan and "LessThan(created_at,2024-01-04T00:00)" in plan


def test_history_is_a_top_k(views):
    plan = explain(topk.history_page(materialise(views.zero_day), page=2))
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_dedupe_is_cut_before_the_shuffle(table, views):
    for df in (sinks.one_per_id(table), scans.alerts_with_baseline(table, views.baseline)):
        plan = explain(df)
        assert "Partial" in plan and "WindowGroupLimit" in plan


def test_counts_are_combined_before_the_shuffle(table):
    plan = explain(agg.value_counts(table, "category"))
    assert "partial_count" in plan and "ReadSchema: struct<category:string>" in plan


def test_day_partitions_are_skipped(spark, views):
    path = scratch_path(spark, "by-day")
    sinks.write_by_day(views.alerts, path)
    stored = spark.read.parquet(path)
    recent = scans.scan_recent(stored, days=3, as_of="2024-01-20 12:00:00")
    assert "PartitionFilters: [isnotnull(event_date" in explain(recent)
    want = scans.scan_recent(views.alerts, days=3, as_of="2024-01-20 12:00:00")
    assert recent.count() == want.count() > 0
    window = scans.detection_window(stored, 24, "2024-01-20 12:00:00")
    assert window.count() == scans.detection_window(views.alerts, 24, "2024-01-20 12:00:00").count() > 0
    assert scans.scan_between(stored, "2024-01-03", "2024-01-05").count() == scans.scan_between(views.alerts, "2024-01-03", "2024-01-05").count()


def test_no_query_plan_gathers_or_crosses(views):
    """No window without a key, no cartesian product, in the heavy relational plans."""
    frames = [
        agg.daily_comparison(views.alerts, views.baseline, views.zero_day, 7, views.as_of),
        agg.time_heatmap(views.zero_day, 30, views.as_of),
        agg.distinct_profile(views.alerts),
        sinks.insert_counts(views.baseline, views.alerts),
    ]
    for df in frames:
        plan = explain(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "Window" not in plan or "hashpartitioning(id" in plan
