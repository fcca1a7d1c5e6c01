"""Baseline upkeep: normal alerts of the last days join the baseline table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.models.scorer import ModelSet
from alertloom.operators import filters, sinks
from alertloom.operators.joins import anti_existing_ids
from alertloom.plans.classify import classify_alerts
from alertloom.schemas import BASELINE_DAYS, BASELINE_MIN_SCORE, BASELINE_SCHEMA


def baseline_candidates(
    alerts: DataFrame, baseline: DataFrame, as_of: str, days: int = BASELINE_DAYS, exclude: list[str] | None = None
) -> DataFrame:
    """Recent alerts outside the excluded categories and not in the baseline yet."""
    recent = filters.exclude_categories(filters.recent_by_created(alerts, days, as_of), exclude)
    return anti_existing_ids(recent, baseline).select(*alerts.columns)


def baseline_additions(
    alerts: DataFrame,
    baseline: DataFrame,
    models: ModelSet,
    as_of: str,
    internal: DataFrame | None = None,
    days: int = BASELINE_DAYS,
    min_score: float = BASELINE_MIN_SCORE,
    exclude: list[str] | None = None,
) -> DataFrame:
    """Rows the update adds, in the layout of the baseline table.

    They are stored as cleaned: missing categories are 'unknown', missing numbers
    and ports 0.
    """
    candidates = baseline_candidates(alerts, baseline, as_of, days, exclude)
    classified = classify_alerts(candidates, models, internal, min_score)
    normal = filters.drop_score_columns(classified.where(~F.col("is_anomaly")))
    return sinks.baseline_rows(normal, as_of)


def update_baseline(
    alerts: DataFrame, path: str, models: ModelSet, as_of: str, **options: object
) -> DataFrame:
    """Appends the new normal rows to the table at `path`; returns the count added."""
    stored = sinks.read_or_empty(alerts.sparkSession, path, BASELINE_SCHEMA)
    return sinks.append_new(path, baseline_additions(alerts, stored, models, as_of, **options), BASELINE_SCHEMA)
