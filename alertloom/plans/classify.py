"""Classifying alerts with the two baseline models, and the report on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions import scores
from alertloom.models.scorer import ModelSet, add_raw_scores
from alertloom.models.thresholds import below
from alertloom.operators import aggregates as agg
from alertloom.operators import topk
from alertloom.plans.preprocess import engineer
from alertloom.schemas import DETECTION_THRESHOLD
from alertloom.storage import materialise


def batch_ranges(scored: DataFrame, models: ModelSet) -> dict[str, scores.BatchRange]:
    """Score ranges: frozen ones where the models carry them, else those of the batch."""
    names = [c for c in ("if_raw", "km_raw", "err") if c in scored.columns]
    if models.ranges:
        return {n: scores.frozen_range(*models.ranges[n]) for n in names}
    return {n: scores.batch_range(scored, n) for n in names}


def score_alerts(alerts: DataFrame, models: ModelSet, internal: DataFrame | None = None) -> DataFrame:
    """Engineered alerts with the raw scores of all models, written once."""
    encoded = models.encode(engineer(alerts, internal, models.uses_frequencies, frozen=models.frequencies))
    return materialise(add_raw_scores(encoded, models).drop("features"), "scored")


def classify_scored(scored: DataFrame, models: ModelSet, threshold: float = DETECTION_THRESHOLD) -> DataFrame:
    """Normalised scores, flags of both models, their union and the combined score."""
    r = batch_ranges(scored, models)
    forest = scores.minmax_normalise(F.col("if_raw"), r["if_raw"])
    kmeans = scores.inverse_minmax(F.col("km_raw"), r["km_raw"])
    out = scored.withColumns({"isolation_forest_score": forest, "kmeans_score": kmeans})
    out = out.withColumns(
        {
            "isolation_forest_anomaly": below(F.col("isolation_forest_score"), threshold),
            "kmeans_anomaly": below(F.col("kmeans_score"), threshold),
        }
    )
    return out.withColumns(
        {
            "is_anomaly": F.col("isolation_forest_anomaly") | F.col("kmeans_anomaly"),
            "anomaly_score": scores.anomaly_score(F.col("isolation_forest_score"), F.col("kmeans_score")),
        }
    )


def classify_alerts(
    alerts: DataFrame, models: ModelSet, internal: DataFrame | None = None, threshold: float = DETECTION_THRESHOLD
) -> DataFrame:
    """Engineered alerts with scores and flags of the baseline models."""
    return classify_scored(score_alerts(alerts, models, internal), models, threshold)


def filter_report(classified: DataFrame) -> dict[str, DataFrame]:
    """Totals, risk per category, sources and examples of a classified batch."""
    return {
        "totals": agg.report_totals(classified, "is_anomaly"),
        "risk_by_category": agg.risk_crosstab(classified),
        "top_sources": agg.top_flagged(classified, "is_anomaly", "src_ip"),
        "low_risk": topk.low_risk_sample(classified),
        "high_risk": topk.top_high_risk(classified),
    }
