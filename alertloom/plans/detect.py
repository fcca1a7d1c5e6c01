"""Detection of suspected novel attacks, its report and its saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions import scores
from alertloom.models.scorer import ModelSet, add_raw_scores
from alertloom.models.thresholds import above, below
from alertloom.operators import aggregates as agg
from alertloom.operators import filters, sinks, topk
from alertloom.plans.classify import batch_ranges
from alertloom.plans.preprocess import engineer
from alertloom.schemas import CATEGORICAL_COLUMNS, DETECTION_THRESHOLD, IP_COLUMNS, NUMERIC_COLUMNS, PORT_COLUMNS, ZERO_DAY_SCHEMA
from alertloom.sources.scans import detection_window
from alertloom.storage import materialise

# Columns that cleaning overwrites; detection reports the alert as it came in.
_CLEANED = CATEGORICAL_COLUMNS + NUMERIC_COLUMNS + PORT_COLUMNS


def score_raw_alerts(alerts: DataFrame, models: ModelSet, internal: DataFrame | None = None) -> DataFrame:
    """Original alert columns, internal flags and raw model scores, written once."""
    kept = [c for c in _CLEANED if c in alerts.columns]
    carried = alerts.withColumn("_original", F.struct(*kept))
    encoded = models.encode(engineer(carried, internal, models.uses_frequencies, frozen=models.frequencies))
    scored = add_raw_scores(encoded, models)
    columns = [F.col(f"_original.{c}").alias(c) if c in kept else F.col(c) for c in alerts.columns]
    flags = [f"{c}_is_internal" for c in IP_COLUMNS if c in alerts.columns]
    return materialise(scored.select(*columns, *flags, "if_raw", "km_raw", "err"), "detect")


def detect_scored(
    scored: DataFrame, models: ModelSet, threshold: float = DETECTION_THRESHOLD, fix_polarity: bool = False
) -> DataFrame:
    """Flags and novelty score from raw scores.

    Novel: abnormal by a baseline model and poorly reconstructed, or coming from
    outside the network.
    """
    r = batch_ranges(scored, models)
    limit = float(models.error_threshold)
    forest = scores.minmax_normalise(F.col("if_raw"), r["if_raw"])
    kmeans = scores.inverse_minmax(F.col("km_raw"), r["km_raw"])
    recon = scores.recon_normalise(F.col("err"), r["err"], F.lit(limit))
    external = F.col("src_ip_is_internal") == 0
    out = scored.withColumns(
        {
            "isolation_forest_score": forest,
            "kmeans_distance": 1 - kmeans,
            "reconstruction_error": F.col("err"),
            "reconstruction_score_normalized": recon,
            "is_baseline_anomaly": below(forest, threshold) | below(kmeans, threshold),
            "is_zero_day_candidate": above(F.col("err"), limit),
        }
    )
    novelty = scores.zero_day_score(
        F.col("reconstruction_score_normalized"),
        F.col("isolation_forest_score"),
        F.col("kmeans_distance"),
        external,
        fix_polarity,
    )
    flagged = (F.col("is_baseline_anomaly") & F.col("is_zero_day_candidate")) | external
    return out.withColumns({"is_zero_day": flagged, "zero_day_score": novelty}).drop("if_raw", "km_raw", "err")


def detect_zero_day(
    alerts: DataFrame,
    models: ModelSet,
    internal: DataFrame | None = None,
    threshold: float = DETECTION_THRESHOLD,
    fix_polarity: bool = False,
) -> DataFrame:
    return detect_scored(score_raw_alerts(alerts, models, internal), models, threshold, fix_polarity)


def zero_day_report(detected: DataFrame) -> dict[str, DataFrame]:
    """Totals, categories, sources and the highest scores among novel attacks."""
    return {
        "anomalies": agg.report_totals(detected, "is_baseline_anomaly"),
        "zero_days": agg.report_totals(detected, "is_zero_day"),
        "by_category": agg.top_flagged(detected, "is_zero_day", agg.category_field(detected)),
        "top_sources": agg.top_flagged(detected, "is_zero_day", "src_ip"),
        "top_scores": topk.top_zero_days(detected),
    }


def save_zero_day(detected: DataFrame, path: str) -> DataFrame:
    """Appends the novel attacks not stored yet; running it twice adds nothing."""
    rows = sinks.zero_day_rows(detected.where("is_zero_day"))
    return sinks.append_new(path, rows, ZERO_DAY_SCHEMA)


def detection_summary(detected: DataFrame, stored: DataFrame) -> DataFrame:
    """Total, abnormal, novel and newly saved rows of one run."""
    novel = detected.where("is_zero_day")
    return _summary(detected, sinks.new_rows(stored.select("id"), novel.select("id")).agg(F.count(F.lit(1))).scalar())


def _summary(detected: DataFrame, saved: Column) -> DataFrame:
    return detected.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if("is_baseline_anomaly").alias("anomaly_count"),
        F.count_if("is_zero_day").alias("zero_day_count"),
    ).withColumn("saved_count", saved)


def detection_details(detected: DataFrame) -> DataFrame:
    return filters.zero_day_detail(detected.where("is_zero_day"))


def run_detection(
    alerts: DataFrame, models: ModelSet, path: str, state_path: str, as_of: str, hours: int = 24, internal: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The whole job: recent alerts, detection, saving, state entry; summary and details.

    The run is recorded also when it finds nothing. Running it again saves nothing
    twice.
    """
    spark = alerts.sparkSession
    detected = detect_zero_day(detection_window(alerts, hours, as_of), models, internal)
    saved = save_zero_day(detected, path).first()["inserted"]
    sinks.log_state(spark, state_path, "last_zero_day_detection_update", as_of)
    return _summary(detected, F.lit(saved).cast("long")), detection_details(detected)
