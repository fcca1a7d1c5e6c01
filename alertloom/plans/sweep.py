"""Sensitivity sweep: what each preset would flag, all from one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions import scores
from alertloom.models.scorer import ModelSet
from alertloom.models.thresholds import SCORE_DIGITS, above, below
from alertloom.operators.quantiles import exact_quantiles
from alertloom.plans.classify import batch_ranges
from alertloom.schemas import BASELINE_MIN_SCORE, DETECTION_THRESHOLD


@dataclass(frozen=True)
class Preset:
    name: str
    percentile: int
    min_score: float
    external_is_zero_day: bool
    baseline_required: bool
    # Scores from here on are normal for the baseline update.
    threshold_score: float = BASELINE_MIN_SCORE


# The four presets.
PRESETS = [
    Preset("当前设置", 98, 0.8, False, True),
    Preset("高精度低召回", 99, 0.9, False, True, 0.8),
    Preset("中等精度中等召回", 97, 0.7, False, True, 0.7),
    Preset("低精度高召回", 95, 0.6, True, False, 0.6),
]
REASONABLE = (1.0, 5.0)


def sweep_base(scored: DataFrame, models: ModelSet, threshold: float = DETECTION_THRESHOLD) -> DataFrame:
    """Per row what every preset needs: error, baseline flag, source flag, score."""
    r = batch_ranges(scored, models)
    forest = scores.minmax_normalise(F.col("if_raw"), r["if_raw"])
    kmeans = scores.inverse_minmax(F.col("km_raw"), r["km_raw"])
    recon = scores.recon_normalise(F.col("err"), r["err"], F.lit(float(models.error_threshold)))
    return scored.select(
        "err",
        (below(forest, threshold) | below(kmeans, threshold)).alias("baseline"),
        (F.col("src_ip_is_internal") == 0).alias("external"),
        scores.zero_day_score(recon, forest, 1 - kmeans, F.lit(False)).alias("score"),
    )


def _metrics(preset: Preset, order: int, cut: float) -> Column:
    external = F.col("external") & F.lit(preset.external_is_zero_day)
    score = F.when(external, F.greatest(F.lit(scores.EXTERNAL_FLOOR), F.col("score"))).otherwise(F.col("score"))
    score = F.round(score, SCORE_DIGITS)
    normal_ok = F.col("baseline") | F.lit(not preset.baseline_required)
    flagged = (above(F.col("err"), cut) & normal_ok & (score >= preset.min_score)) | external
    return F.struct(
        F.lit(order).alias("preset_order"),
        F.lit(preset.name).alias("config_name"),
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if("baseline").alias("anomaly_count"),
        F.count_if(flagged).alias("zero_day_count"),
        F.avg(F.when(flagged, score)).alias("mean_score"),
    )


def sensitivity_sweep(
    scored: DataFrame, models: ModelSet, presets: list[Preset] | None = None, threshold: float = DETECTION_THRESHOLD
) -> DataFrame:
    """One row of counts and rates per preset.

    The error percentiles are read first; then a single aggregation carries one
    group of counters per preset, so the rows are neither copied per preset nor
    read again.
    """
    chosen = PRESETS if presets is None else presets
    cuts = exact_quantiles(scored, "err", sorted({p.percentile / 100 for p in chosen}))
    base = sweep_base(scored, models, threshold)
    groups = F.array(*[_metrics(p, i, cuts[p.percentile / 100] or 0.0) for i, p in enumerate(chosen)])
    rows = base.agg(groups.alias("g")).select(F.explode("g").alias("r")).select("r.*")
    return rows.select(
        "preset_order",
        "config_name",
        "total_alerts",
        "anomaly_count",
        "zero_day_count",
        scores.percentage(F.col("anomaly_count"), F.col("total_alerts")).alias("anomaly_rate"),
        scores.percentage(F.col("zero_day_count"), F.col("total_alerts")).alias("zero_day_rate"),
        scores.percentage(F.col("zero_day_count"), F.col("anomaly_count")).alias("zero_day_of_anomaly_rate"),
        F.round(F.coalesce("mean_score", F.lit(0.0)), 3).alias("avg_zero_day_score"),
    )


def preset_baselines(scored: DataFrame, models: ModelSet, presets: list[Preset] | None = None) -> DataFrame:
    """How many alerts the baseline update would take as normal under each preset, in one pass."""
    r = batch_ranges(scored, models)
    forest = scores.minmax_normalise(F.col("if_raw"), r["if_raw"])
    kmeans = scores.inverse_minmax(F.col("km_raw"), r["km_raw"])
    chosen = PRESETS if presets is None else presets

    def row(order: int, preset: Preset) -> Column:
        t = preset.threshold_score
        normal = F.count_if(~(below(F.col("forest"), t) | below(F.col("kmeans"), t)))
        return F.struct(F.lit(order).alias("preset_order"), F.lit(preset.name).alias("config_name"), F.lit(t).alias("threshold_score"), F.count(F.lit(1)).alias("total_alerts"), normal.alias("normal_count"))

    groups = F.array(*[row(i, p) for i, p in enumerate(chosen)])
    return scored.select(forest.alias("forest"), kmeans.alias("kmeans")).agg(groups.alias("g")).select(F.explode("g").alias("r")).select("r.*")


def reasonable_configs(sweep: DataFrame) -> DataFrame:
    """Presets that flag between 1 and 5 percent of the alerts."""
    return sweep.where(F.col("zero_day_rate").between(*REASONABLE))


def best_config(sweep: DataFrame) -> DataFrame:
    """The reasonable preset with the greatest share of anomalies; the first wins ties."""
    order = F.struct("zero_day_of_anomaly_rate", -F.col("preset_order"))
    picked = F.max_by(F.struct("config_name", "zero_day_rate", "zero_day_of_anomaly_rate"), order)
    return reasonable_configs(sweep).agg(picked.alias("b")).where("b IS NOT NULL").select("b.*")
