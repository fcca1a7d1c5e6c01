from __future__ import annotations

import pytest
from alertloom.models import thresholds
from alertloom.models.scorer import add_raw_scores
from alertloom.plans import baseline, classify, detect, sweep, train
from alertloom.queries import literal, scoring
from alertloom.schemas import BASELINE_SCHEMA
from alertloom.storage import materialise, scratch_path
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def detected(medium):
    return materialise(detect.detect_zero_day(medium.alerts, scoring.with_threshold(medium)))


def test_known_counts_of_the_fixed_models(medium, detected):
    counts = detected.agg(
        F.count("*"), F.count_if("is_baseline_anomaly"), F.count_if("is_zero_day_candidate"), F.count_if("is_zero_day"), F.count_if(F.col("src_ip_is_internal") == 0)
    ).first()
    external = counts[4]
    # 2001:db8::* counts as internal under the full address rule.
    documentation = medium.alerts.where("src_ip LIKE '2001:db8:%'").count()
    assert tuple(counts)[:3] == (10_000, 5_240, 500)
    assert external == 1_417 - documentation
    anomalies = classify.classify_alerts(medium.alerts, literal.literal_models(), threshold=0.5)
    assert anomalies.where("is_anomaly").count() == 1_948
    assert baseline.baseline_candidates(medium.alerts, medium.baseline, medium.as_of).count() == 4_072


def test_f1_threshold_of_the_fixed_forest(medium):
    models = literal.literal_models()
    raw = add_raw_scores(models.encode(medium.alerts), models)
    scored = classify.classify_scored(raw, models)
    best = thresholds.threshold_by_f1(scored.withColumn("y", F.col("threat_level") == 40), "isolation_forest_score", "y").first()
    assert best.threshold == 0.6 and best.f1 == pytest.approx(0.835757, abs=1e-6)


def test_detection_keeps_nulls_and_classification_fills_them(alerts):
    models = literal.literal_models(0.5)
    df = alerts({"category": None, "dst_port": None}, {"bytes_to_server": 9000})
    found = detect.detect_zero_day(df, models).orderBy("id").first()
    assert found.category is None and found.dst_port is None
    filled = classify.classify_alerts(df, models).orderBy("id").first()
    assert filled.category == "unknown" and filled.dst_port == 0


def test_missing_and_unreadable_sources_are_novel(alerts):
    df = alerts({"src_ip": None}, {"src_ip": "junk"}, {"src_ip": "8.8.8.8"}, {"src_ip": "10.0.0.1"})
    got = detect.detect_zero_day(df, literal.literal_models(1e9)).orderBy("id").collect()
    assert [r.is_zero_day for r in got] == [True, True, True, False]
    assert all(r.zero_day_score >= 0.7 for r in got[:3])


def test_one_alert(alerts):
    models = literal.literal_models(1e9)
    row = detect.detect_zero_day(alerts({}), models).first()
    assert (row.isolation_forest_score, row.kmeans_distance) == (0.5, 0.5)
    assert row.reconstruction_score_normalized == pytest.approx(row.reconstruction_error / 1e9)


def test_no_alerts(alerts):
    models = literal.literal_models(1.0)
    empty = alerts({}).limit(0)
    found = detect.detect_zero_day(empty, models)
    assert found.count() == 0 and "zero_day_score" in found.columns
    assert classify.classify_alerts(empty, models).count() == 0
    assert detect.detection_summary(found, found).first().asDict() == {"total_alerts": 0, "anomaly_count": 0, "zero_day_count": 0, "saved_count": 0}
    assert sweep.sensitivity_sweep(detect.score_raw_alerts(empty, models), models).count() == 4


def test_saving_twice_adds_nothing(spark, detected):
    path = scratch_path(spark, "zero-day")
    first = detect.save_zero_day(detected, path).first().inserted
    assert first == detected.where("is_zero_day").count() > 0
    assert detect.save_zero_day(detected, path).first().inserted == 0
    assert spark.read.parquet(path).count() == first


def test_updating_twice_adds_nothing(spark, views):
    path = scratch_path(spark, "baseline")
    models = literal.literal_models()
    first = baseline.update_baseline(views.alerts, path, models, views.as_of).first().inserted
    stored = spark.read.parquet(path)
    assert first == stored.count() > 0 and stored.schema.fieldNames() == [*BASELINE_SCHEMA.fieldNames(), "event_date"]
    assert stored.where("protocol = 'unknown'").count() > 0
    # Normal scores are relative to the batch, so a second run judges the rest anew.
    again = baseline.update_baseline(views.alerts, path, models, views.as_of).first().inserted
    assert spark.read.parquet(path).select("id").distinct().count() == first + again == spark.read.parquet(path).count()


def test_presets_are_effective(detected, medium):
    models = scoring.with_threshold(medium)
    counts = [r.zero_day_count for r in sweep.sensitivity_sweep(detect.score_raw_alerts(medium.alerts, models), models).orderBy("preset_order").collect()]
    assert len(set(counts)) > 1 and counts[3] > counts[1]


def test_training_end_to_end(spark, views):
    done = train.train_baseline(views.alerts, views.baseline, as_of=views.as_of_event, trees=20, k=3)
    report = {r.model: r for r in done.reports["models"].collect()}
    n = views.alerts.count()
    assert report["isolation_forest"].data_count == n and report["isolation_forest"].anomaly_count == int(n * 0.05)
    scores = done.scored.agg(F.min("if_score"), F.max("if_score"), F.min("km_score"), F.max("km_score")).first()
    assert all(-1e-9 <= s <= 1 for s in scores)
    novel = train.train_zero_day(views.baseline, done.models, encoding_dim=4, epochs=2)
    assert novel.reports["losses"].count() == 2 and novel.models.error_threshold > 0
    above = novel.scored.where(F.col("err") > novel.models.error_threshold).count()
    assert above == pytest.approx(views.baseline.count() * 0.05, abs=2)
    assert novel.reports["reconstructions"].count() == 5
    found = detect.detect_zero_day(views.alerts, novel.models)
    assert found.count() == n and found.where("is_zero_day").count() > 0


def test_training_without_baseline_or_rows(views):
    rows = train.training_rows(views.alerts, None, views.as_of_event)
    assert rows.count() == views.alerts.count()
    with pytest.raises(ValueError, match="no alerts"):
        train.train_baseline(views.alerts.limit(0), as_of=views.as_of_event)
