from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from alertloom.functions import scores
from alertloom.operators import aggregates as agg
from alertloom.operators import filters, joins, paging, profiles, sinks, topk
from alertloom.operators.quantiles import approx_quantiles, exact_quantiles, kth_smallest, order_statistics
from alertloom.plans import dashboards
from alertloom.schemas import ALERT_COLUMNS, BASELINE_SCHEMA
from alertloom.sources import scans
from alertloom.storage import scratch_path
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("limit", [0, 1000])
def test_lookup_with_hot_null_and_missing_keys(spark, limit):
    fact = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"))
    dim = spark.range(1, 30_000, 6).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.lit(1).alias("v"))
    dim = dim.unionByName(spark.createDataFrame([("hot", 7)], "k string, v int"))
    got = joins.lookup(fact, dim, "key", "k", broadcast_rows=limit)
    assert got.columns == ["id", "key", "v"]
    summary = {r.v: r.n for r in got.groupBy("v").agg(F.count("*").alias("n")).collect()}
    matched = dim.count() - 1
    assert summary == {7: 10_000, 1: matched, None: 20_000 - matched}


def test_hot_keys_are_few_and_found(spark):
    fact = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    hot = joins._hot_hashes(fact, "k")
    expected = spark.range(1).select(F.xxhash64(F.lit(-1).cast("bigint"))).first()[0]
    assert hot == [expected]
    # A hot key without a partner stays null and no row is lost.
    got = joins.lookup(fact, spark.range(10).select("id", F.lit(1).alias("v")), "k", "id", broadcast_rows=0)
    assert got.count() == 50_000 and got.where("v = 1").count() == 6


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    sets = {
        0: rng.normal(size=2000),
        1: np.concatenate([np.zeros(1500), rng.pareto(0.3, 500) * 1e6]),
        2: rng.integers(0, 5, 999).astype(float),
    }
    x = sets[seed]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    fractions = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, "x", fractions)
    for f in fractions:
        assert got[f] == pytest.approx(np.percentile(x, f * 100), rel=1e-12, abs=1e-12)
    ordered = np.sort(x)
    assert order_statistics(df, "x", [0, 17, 500]) == {k: ordered[k] for k in (0, 17, 500)}
    assert kth_smallest(df, "x", 0.05) == ordered[int(len(x) * 0.05)]


def test_quantiles_of_nothing_and_of_one(spark):
    assert exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == {0.5: None}
    assert exact_quantiles(spark.createDataFrame([(3,)], "x int"), "x", [0.5]) == {0.5: 3.0}


def test_normalising_edge_batches(spark):
    one = spark.createDataFrame([(4.0,)], "x double")
    constant = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    for df, forest, kmeans, recon in [(one, 0.5, 0.5, 0.8), (constant, 0.0, 0.5, 0.0)]:
        r = scores.batch_range(df, "x")
        row = df.select(
            scores.minmax_normalise(F.col("x"), r), scores.inverse_minmax(F.col("x"), r), scores.recon_normalise(F.col("x"), r, F.lit(5.0))
        ).first()
        assert tuple(row) == pytest.approx((forest, kmeans, recon))
    r = scores.batch_range(one, "x")
    assert one.select(scores.recon_normalise(F.col("x"), r, F.lit(3.0))).first()[0] == 1.0


def test_external_floor_and_polarity(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, True), (0.1, 0.2, 0.3, False)], "r double, f double, k double, e boolean")
    args = [F.col(c) for c in "rfke"]
    got = [x[0] for x in df.select(scores.zero_day_score(*args)).collect()]
    assert got == pytest.approx([0.7, 0.7 * 0.1 + 0.3 * 0.25])
    turned = [x[0] for x in df.select(scores.zero_day_score(*args, fix_polarity=True)).collect()]
    assert turned[1] == pytest.approx(0.7 * 0.1 + 0.3 * 0.55)


def test_alerts_win_over_baseline_and_copies_collapse(alerts):
    live = alerts({"id": 1, "signature": "live"}, {"id": 1, "signature": "live"}, {"id": 2})
    base = alerts({"id": 1, "signature": "old"}, {"id": 3, "signature": "old"}).withColumn("added_to_baseline_at", F.lit(None).cast("timestamp_ntz"))
    got = scans.alerts_with_baseline(live, base)
    assert sorted((r.id, r.signature, r.from_baseline) for r in got.collect()) == [(1, "live", 0), (2, "sig", 0), (3, "old", 1)]


def test_null_category_is_dropped_by_exclusion(alerts):
    df = alerts({"category": None}, {"category": "勒索软件"}, {"category": "端口扫描"})
    assert [r.id for r in filters.exclude_categories(df).collect()] == [2]
    assert filters.exclude_categories(df, []).count() == 3


def test_insert_if_absent_is_idempotent(spark, alerts):
    path = scratch_path(spark, "test-table")
    batch = alerts({"id": 1}, {"id": 1}, {"id": 2, "category": None})
    first = sinks.append_new(path, sinks.baseline_rows(batch, "2024-01-06 00:00:00"), BASELINE_SCHEMA).first().inserted
    again = sinks.append_new(path, sinks.baseline_rows(batch, "2024-01-06 00:00:00"), BASELINE_SCHEMA).first().inserted
    stored = spark.read.parquet(path)
    assert (first, again, stored.count()) == (2, 0, 2)
    assert {r.category for r in stored.collect()} == {"SQL注入", ""}
    assert rows(sinks.insert_counts(stored, batch)) == [(3, 0, 3)]


def test_storage_projection_keeps_order_and_types(alerts):
    df = alerts({}).withColumn("extra", F.lit(1)).withColumn("threat_level", F.lit(True)).select("extra", "threat_level", "id", "src_ip")
    out = sinks.project_storage_columns(df)
    assert out.dtypes == [("id", "bigint"), ("threat_level", "int"), ("src_ip", "string")]


def test_state_log(spark):
    log = spark.createDataFrame(
        [("last_a_update", "2024-01-01 00:00:00", datetime(2024, 1, 1)), ("last_a_update", "2024-01-02 03:04:05", datetime(2024, 1, 2)), ("last_b_update", "bad", datetime(2024, 1, 1))],
        "config_key string, config_value string, last_updated timestamp_ntz",
    )
    got = {r.component: r.last_update_text for r in sinks.last_update_times(log, ["a", "b", "c"]).collect()}
    assert got == {"a": "2024-01-02 03:04:05", "b": None, "c": None}
    assert rows(sinks.state_get(log, ["x"], "none")) == [("x", "none")]


def test_date_spine_fills_gaps_and_spans_years(alerts):
    df = alerts({"created_at": datetime(2024, 1, 1, 12)}, {"created_at": datetime(2023, 12, 30, 13)}, {"created_at": datetime(2023, 12, 30, 11)})
    got = rows(agg.daily_comparison(df, df.limit(0), df.limit(0), 2, "2024-01-01 12:00:00").orderBy("date"))
    assert [(r[0], *r[2:]) for r in got] == [("12-30", 1, 1, 0), ("12-31", 0, 0, 0), ("01-01", 1, 1, 0)]
    assert agg.daily_comparison(df.limit(0), df, df.limit(0), 2, "2024-01-01 12:00:00").count() == 0


def test_distinct_counts_null_as_a_value(alerts):
    df = alerts({"category": None}, {"category": "a"}, {"category": "a"})
    assert agg.distinct_profile(df, ["category", "event_type"]).first().asDict() == {"category": 2, "event_type": 1}
    assert agg.distinct_profile(df.limit(0), ["category"]).first()[0] == 0


def test_report_of_no_rows(alerts):
    assert rows(agg.report_totals(alerts({}).limit(0).withColumn("flag", F.lit(True)), "flag")) == [(0, 0, 0, 0.0, 0.0)]


def test_unknown_chart_is_an_error(views):
    with pytest.raises(ValueError, match="monthly"):
        dashboards.chart("monthly", views.alerts, views.baseline, views.zero_day, views.as_of)


def test_history_ties_break_by_id(alerts):
    same = datetime(2024, 1, 1)
    df = alerts(*[{"id": i, "created_at": same} for i in (5, 3, 9, 1)]).withColumn("zero_day_score", F.lit(0.5))
    assert [r.id for r in topk.history_page(df, page=2, page_size=2).collect()] == [5, 9]
    assert rows(topk.history_totals(df, page_size=3)) == [(4, 2)]


def test_window_keeps_time_of_day(alerts):
    now = datetime(2024, 1, 10, 12)
    df = alerts(*[{"created_at": now - timedelta(days=7, seconds=s)} for s in (-1, 0, 1)])
    assert filters.recent_by_created(df, 7, str(now)).count() == 2


def test_param_sql_binds_values(alerts, spark):
    df = alerts({"category": "a' OR '1'='1"}, {})
    got = scans.param_sql(spark, "SELECT id FROM {t} WHERE category = :c", {"c": "a' OR '1'='1"}, t=df)
    assert rows(got) == [(0,)]


def test_sink_columns_are_the_alert_columns(alerts):
    assert sinks.project_storage_columns(alerts({})).columns == ALERT_COLUMNS


def test_one_pass_variants_agree_on_small_data(spark, views):
    exact = agg.distinct_profile(views.alerts).first()
    close = agg.distinct_profile(views.alerts, approximate=True).first()
    assert all(abs(a - b) <= 0.1 * a + 1 for a, b in zip(exact, close, strict=True))
    row = approx_quantiles(spark.range(1, 1001).selectExpr("double(id) AS x"), "x").first()
    assert (row.min_value, row.max_value, row.q50) == (1.0, 1000.0, 500.0)


def test_jdbc_reads_are_split():
    options = scans.jdbc_options("jdbc:mysql://host/db", "alerts", 1, 1000, 8)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8" and options["upperBound"] == "1000"


def test_files_of_other_formats(spark, alerts):
    for fmt in ("orc", "json"):
        path = scratch_path(spark, fmt)
        alerts({}, {}).select("id", "category").write.format(fmt).save(path)
        assert scans.read_table(spark, path, fmt).count() == 2


def test_quantiles_of_odd_values_end(spark):
    nan, inf = float("nan"), float("inf")
    values = [nan, inf, -inf, -inf, 1e308, -1e308, 0.0, 1e-300, 5.0, 5.0, 5.0, nan]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    order = [-inf, -inf, -1e308, 0.0, 1e-300, 5.0, 5.0, 5.0, 1e308, inf, nan, nan]
    got = order_statistics(df, "x", list(range(12)))
    assert [got[k] for k in range(10)] == order[:10] and all(np.isnan(got[k]) for k in (10, 11))
    assert exact_quantiles(df.where("x in (5)"), "x", [0.0, 0.5, 1.0]) == {0.0: 5.0, 0.5: 5.0, 1.0: 5.0}
    assert kth_smallest(df.limit(0), "x", 0.5) is None


def test_quantiles_of_skewed_values_take_few_passes(spark, monkeypatch):
    df = spark.range(20_000).select(F.exp(F.col("id") / 30.0).alias("x"))
    passes = []
    real = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: passes.append(1) or real(self, *a))
    assert order_statistics(df, "x", [10_000])[10_000] == pytest.approx(float(np.exp(10_000 / 30.0)))
    assert len(passes) <= 9


def test_frozen_ranges_keep_scores_within_bounds(spark):
    df = spark.createDataFrame([(-5.0,), (0.5,), (20.0,)], "x double")
    r = scores.frozen_range(0.0, 1.0)
    rows_ = df.select(scores.minmax_normalise(F.col("x"), r), scores.inverse_minmax(F.col("x"), r), scores.recon_normalise(F.col("x"), r, F.lit(1.0))).collect()
    assert all(0 <= v <= 1 for row in rows_ for v in row)


def test_copies_of_a_saved_score_do_not_multiply_alerts(spark):
    alerts_ = spark.createDataFrame([(1,), (2,)], "id long")
    saved = spark.createDataFrame([(1, 0.5), (1, 0.9)], "id long, zero_day_score double")
    assert sorted(rows(joins.score_lookup(alerts_, saved)), key=lambda r: r[0]) == [(1, 0.9), (2, None)]


def test_percent_marks_inside_quotes_stay(spark):
    got = scans.param_sql(spark, "SELECT '%s' AS a, %s AS b, \"x%s\" AS c", [7]).first()
    assert tuple(got) == ("%s", 7, "x%s")


def test_shared_folder_is_needed_off_one_machine(spark, monkeypatch):
    from alertloom import storage

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(Session())


def test_scratch_copies_go_when_a_job_ends(spark):
    from pathlib import Path

    from alertloom import storage

    with storage.scratch(spark):
        kept = storage.materialise(spark.range(5), "gone")
        folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists()
    assert not folder.exists()


@pytest.fixture(scope="module")
def dated(spark):
    """Rows of uneven days, with one moment that very many rows share, and rows without a time."""
    moment = F.when(F.col("id") % 3 == 0, F.lit("2024-03-05 10:00:07").cast("timestamp_ntz")).when(F.col("id") % 50 == 1, None)
    other = F.timestamp_add("SECOND", (F.col("id") * 7919 % 400_000).cast("int"), F.lit("2024-03-03 00:00:00").cast("timestamp_ntz"))
    return spark.range(3_000).select("id", F.coalesce(moment, F.when(F.col("id") % 50 != 1, other)).alias("created_at")).repartition(4)


@pytest.mark.parametrize("stretch", [20_000, 100, 1])
@pytest.mark.parametrize("skip", [0, 5, 990, 1_500, 1_983, 2_930, 2_995, 5_000])
def test_deep_pages_equal_sorted_slices(dated, skip, stretch):
    want = [r.id for r in dated.orderBy(F.desc("created_at"), "id").collect()][skip : skip + 25]
    assert [r.id for r in paging.deep_page(dated, skip, 25, stretch_rows=stretch).collect()] == want


def test_a_deep_page_opens_its_days_only(spark, dated):
    """Page of a stored history: one day in the scan, with the stored index and with bounds."""
    path, index = scratch_path(spark, "history"), scratch_path(spark, "history-index")
    paging.write_history(dated, path, index)
    stored, counts = spark.read.parquet(path), spark.read.parquet(index)
    page = paging.deep_page(stored, 2_000, 10, counts)
    plan = page._jdf.queryExecution().toString()
    days = {str(r.created_at.date()) for r in page.collect()}
    assert len(days) == 1 and f"created_date#" in plan and plan.count(f"IN ({days.copy().pop()})") + plan.count(f"= {days.copy().pop()}") > 0
    bounded = paging.history_deep_page(stored, "2024-03-04", "2024-03-05", page=40, page_size=10, index=counts)
    want = dated.where("created_at >= '2024-03-04' and created_at < '2024-03-06'").orderBy(F.desc("created_at"), "id").collect()[390:400]
    assert [r.id for r in bounded.collect()] == [r.id for r in want]


def test_history_turns_to_ranks_for_deep_pages(dated, monkeypatch):
    monkeypatch.setattr(topk, "SHALLOW_ROWS", 100)
    want = [r.id for r in dated.where("created_at is not null").orderBy(F.desc("created_at"), "id").collect()]
    got = topk.history_page(dated.where("created_at is not null"), page=21, page_size=10).collect()
    assert [r.id for r in got] == want[200:210]


def test_window_profiles_from_day_sketches(spark):
    """Any run of days from stored sketches: exact quantiles, near distinct counts; null, odd and absent days."""
    rng = np.random.default_rng(2)
    start = datetime(2024, 5, 1)
    x = np.round(rng.lognormal(0, 2, 6_000), 3)
    made = [(start + timedelta(hours=int(i % 240)), float(v), f"s{int(v * 10) % 700}" if i % 9 else None) for i, v in enumerate(x)] + [(None, 1.0, "z"), (start, None, None)]
    df = spark.createDataFrame(made, "event_time timestamp_ntz, v double, src_ip string")
    path = scratch_path(spark, "sketches")
    profiles.daily_sketches(df, numbers=["v"]).write.parquet(path)
    stored = spark.read.parquet(path)
    for first, last in (("2024-05-02", "2024-05-04"), ("2024-05-01", "2024-05-31"), ("2024-05-10", "2024-05-10")):
        own = [r for r in made if r[0] is not None and first <= str(r[0].date()) <= last]
        values = [r[1] for r in own if r[1] is not None]
        got = profiles.window_quantiles(df, stored, "v", [0.0, 0.25, 0.5, 0.95, 1.0], first, last)
        assert got == pytest.approx({f: np.quantile(values, f) for f in got})
        row = profiles.window_profile(stored, first, last).first()
        distinct = len({r[2] for r in own})
        assert row["rows"] == len(own) and abs(row["src_ip"] - distinct) <= 0.05 * distinct + 1
    assert profiles.window_quantiles(df, stored, "v", [0.5], "2023-01-01", "2023-02-01") == {0.5: None}
    odd = df.union(spark.createDataFrame([(start, float("nan"), "n")], df.schema))
    sketches = profiles.daily_sketches(odd, numbers=["v"])
    assert profiles.window_quantiles(odd, sketches, "v", [0.5], "2024-05-01", "2024-05-01")[0.5] == pytest.approx(float(exact_quantiles(odd.where("event_time < DATE '2024-05-02'"), "v", [0.5])[0.5]))
