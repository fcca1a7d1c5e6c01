"""Training jobs: baseline models on recent alerts, novelty model on the baseline."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions import scores
from alertloom.models import autoencoder as ae
from alertloom.models import clustering, forest, reduction
from alertloom.models.encoding import fit_encoder
from alertloom.models.scorer import Clusters, ModelSet, add_raw_scores, reconstruction_sample
from alertloom.models.store import save_models
from alertloom.models.thresholds import model_report, recon_threshold
from alertloom.operators import aggregates as agg
from alertloom.operators.sinks import log_state
from alertloom.plans.preprocess import engineer, frequency_table
from alertloom.schemas import TRAINING_DAYS
from alertloom.sources.scans import alerts_with_baseline, scan_baseline
from alertloom.storage import materialise, spread

# Share of anomalies assumed in training, and the class default
# that k-means keeps.
CONTAMINATION = {"isolation_forest": 0.05, "kmeans": 0.1}


@dataclass(frozen=True)
class Training:
    """Fitted models, the training rows with their scores, and the reports."""

    models: ModelSet
    scored: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    frequencies: DataFrame | None = None

    @property
    def frozen(self) -> ModelSet:
        """The models with the score ranges and frequencies of the training rows: they
        score a row alike in any batch, and can start a stream."""
        return replace(self.models, ranges=self.models.ranges | self.ranges, frequencies=self.frequencies or self.models.frequencies)


def training_rows(
    alerts: DataFrame, baseline: DataFrame | None, as_of: str | None, days: int = TRAINING_DAYS
) -> DataFrame:
    """Alerts of the training window, with the baseline unless it is left out."""
    empty = alerts.limit(0) if baseline is None else baseline
    return alerts_with_baseline(alerts, empty, days, as_of).select(*alerts.columns)


def frozen_ranges(scored: DataFrame) -> dict[str, tuple[float, float]]:
    """Score ranges of the training rows, for scoring outside batches."""
    names = [c for c in ("if_raw", "km_raw", "err") if c in scored.columns]
    row = scores.minmax_stats(scored, names).first()
    return {n: (row[f"{n}_min"], row[f"{n}_max"]) for n in names}


def train_baseline(
    alerts: DataFrame,
    baseline: DataFrame | None = None,
    internal: DataFrame | None = None,
    as_of: str | None = None,
    days: int = TRAINING_DAYS,
    trees: int = forest.TREES,
    k: int | None = None,
) -> Training:
    """Encoder, isolation forest, and k-means on the reduced rows."""
    rows = training_rows(alerts, baseline, as_of, days)
    frequencies = frequency_table(rows)
    engineered = materialise(engineer(spread(rows), internal, frozen=frequencies), "engineered")
    encoder = fit_encoder(engineered)
    encoded = materialise(encoder(engineered), "encoded")
    n = encoded.count()
    if n == 0:
        raise ValueError("no alerts to train on")
    nodes = forest.fit_forest(encoded, n, trees)
    trees_fitted = forest.forest_from_nodes(nodes, n)
    projection, offset = reduction.reduction_for(encoded, encoder.width)
    reduced = materialise(reduction.add_reduced(encoded.select("id", "features"), projection, offset).select("id", "reduced"), "reduced")
    centres = clustering.kmeans_fit(reduced, k) if k else clustering.kmeans_select_k(reduced, n)[1]
    models = ModelSet(encoder, encoder.width, trees_fitted, Clusters(projection, centres, offset))
    raw = materialise(add_raw_scores(encoded, models).drop("features"), "train-scored")
    ranges = frozen_ranges(raw)
    forest_score = scores.minmax_normalise(F.col("if_raw"), scores.frozen_range(*ranges["if_raw"], rows=n))
    kmeans_score = scores.inverse_minmax(F.col("km_raw"), scores.frozen_range(*ranges["km_raw"], rows=n))
    scored = raw.withColumns({"if_score": forest_score, "km_score": kmeans_score})
    report = model_report(scored, {"isolation_forest": "if_score", "kmeans": "km_score"}, CONTAMINATION, encoder.width)
    report = materialise(report, "model-report")
    limits = {r["model"]: r["threshold"] for r in report.select("model", "threshold").collect()}
    models = replace(models, flag_thresholds=limits)
    flagged = scored.withColumn("is_anomaly", F.col("if_score") < limits["isolation_forest"])
    reports = {
        "models": report,
        "anomalous_categories": agg.top_flagged(flagged, "is_anomaly", "category"),
        "anomalous_event_types": agg.top_flagged(flagged, "is_anomaly", "event_type"),
    }
    return Training(models, scored, reports, ranges, frequencies)


def train_zero_day(
    baseline: DataFrame,
    models: ModelSet,
    internal: DataFrame | None = None,
    encoding_dim: int = ae.TRAINING_ENCODING_DIM,
    epochs: int = ae.EPOCHS,
    error_threshold: float | None = None,
    seed: int = 42,
) -> Training:
    """Autoencoder on the baseline rows, with the encoder fitted before.

    The error threshold is the 95th percentile of the training errors unless
    one is given.
    """
    encoded = materialise(models.encode(engineer(spread(scan_baseline(baseline)), internal, frozen=models.frequencies)), "ae-encoded")
    fitted, history = ae.fit_autoencoder(encoded, models.width, encoding_dim, epochs, seed=seed)
    complete = replace(models, autoencoder=fitted)
    scored = materialise(add_raw_scores(encoded, complete).drop("features"), "ae-scored")
    limit = error_threshold if error_threshold is not None else recon_threshold(scored)
    complete = replace(complete, error_threshold=limit)
    losses = [(h["epoch"], float(h["loss"]), float(h["val_loss"])) for h in history]
    reports = {
        "losses": baseline.sparkSession.createDataFrame(losses, "epoch int, loss double, val_loss double"),
        "reconstructions": reconstruction_sample(encoded, complete),
    }
    return Training(complete, scored, reports, frozen_ranges(scored.select("err")))


def run_baseline_training(alerts: DataFrame, baseline: DataFrame | None, path: str, state_path: str, as_of: str, internal: DataFrame | None = None, **options: object) -> Training:
    """Trains the baseline models, stores them fit for streams, and records the run."""
    done = train_baseline(alerts, baseline, internal, as_of, **options)
    save_models(alerts.sparkSession, done.frozen, path)
    log_state(alerts.sparkSession, state_path, "last_baseline_model_update", as_of)
    return replace(done, models=done.frozen)


def run_zero_day_training(baseline: DataFrame, models: ModelSet, path: str, state_path: str, as_of: str, internal: DataFrame | None = None, **options: object) -> Training:
    """Trains the novelty model, stores the completed set, and records the run."""
    done = train_zero_day(baseline, models, internal, **options)
    save_models(baseline.sparkSession, done.frozen, path)
    log_state(baseline.sparkSession, state_path, "last_zero_day_model_update", as_of)
    return replace(done, models=done.frozen)


def with_frozen_frequencies(models: ModelSet, alerts: DataFrame) -> ModelSet:
    """Models that look frequencies up in a table of these alerts; streams need them."""
    return replace(models, frequencies=frequency_table(alerts))


def with_frozen_ranges(models: ModelSet, scored: DataFrame) -> ModelSet:
    """Models that normalise by the ranges of `scored` instead of each batch's."""
    return replace(models, ranges=frozen_ranges(scored))
