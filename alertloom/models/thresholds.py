"""Thresholds and quality figures over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.aggregates import union_all
from alertloom.operators.quantiles import exact_quantiles, kth_smallest

# Flags compare scores at this many decimals, so that a flag never hangs on the
# last bits of a floating-point sum.
SCORE_DIGITS = 6
GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def below(score: Column, threshold: float | Column) -> Column:
    return F.round(score, SCORE_DIGITS) < threshold


def is_anomaly(df: DataFrame, score: str, threshold: float, out: str = "is_anomaly") -> DataFrame:
    return df.withColumn(out, below(F.col(score), threshold))


def _confusion(score: Column, label: Column, t: float) -> Column:
    guess = below(score, t)
    return F.struct(
        F.lit(t).alias("threshold"),
        F.count_if(guess & label).alias("tp"),
        F.count_if(guess & ~label).alias("fp"),
        F.count_if(~guess & label).alias("fn"),
        F.count_if(~guess & ~label).alias("tn"),
    )


def threshold_grid(df: DataFrame, score: str, label: str, grid: list[float] | None = None) -> DataFrame:
    """Confusion counts at every threshold, all from one pass over the rows."""
    cells = F.array(*[_confusion(F.col(score), F.col(label), t) for t in (grid or GRID)])
    return df.agg(cells.alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 beside confusion counts; 0 where undefined."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp = F.col("tp")
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + F.col("fp")),
            "recall": ratio(tp, tp + F.col("fn")),
            "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")),
        }
    )


def threshold_by_f1(df: DataFrame, score: str, label: str, default: float = 0.8) -> DataFrame:
    """Grid threshold of the best F1; the smallest wins ties; default if all are 0."""
    scored = classification_metrics(threshold_grid(df, score, label))
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    row = scored.where("f1 > 0").agg(best.alias("b"))
    return row.select(
        F.coalesce(F.col("b.threshold"), F.lit(default)).alias("threshold"),
        *[F.coalesce(F.col(f"b.{c}"), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
    )


def threshold_by_contamination(df: DataFrame, score: str, contamination: float) -> float | None:
    """The score below which the expected share of anomalies lies."""
    return kth_smallest(df, score, contamination)


def model_report(df: DataFrame, scores: dict[str, str], contamination: dict[str, float], feature_dim: int) -> DataFrame:
    """Per model its threshold and how many rows fall below it."""
    parts = []
    for model, score in scores.items():
        threshold = threshold_by_contamination(df, score, contamination[model])
        flagged = F.count_if(F.col(score) < F.lit(threshold))
        total = F.count(F.lit(1))
        parts.append(
            df.agg(flagged.alias("anomaly_count"), total.alias("data_count")).select(
                F.lit(model).alias("model"),
                F.lit(threshold).cast("double").alias("threshold"),
                "anomaly_count",
                (F.col("anomaly_count") / F.col("data_count") * 100).alias("anomaly_percent"),
                F.lit(feature_dim).alias("feature_dim"),
                "data_count",
            )
        )
    return union_all(parts)


def recon_threshold(df: DataFrame, column: str = "err", fraction: float = 0.95) -> float | None:
    """Error threshold: the 95th percentile of the training errors."""
    return exact_quantiles(df, column, [fraction])[fraction]


def is_zero_day(df: DataFrame, threshold: float, column: str = "err") -> DataFrame:
    return df.withColumn("is_zero_day", above(F.col(column), threshold))


def above(error: Column, threshold: float) -> Column:
    """Is the error over the threshold, both at SCORE_DIGITS decimals?"""
    return F.round(error, SCORE_DIGITS) > F.round(F.lit(float(threshold)), SCORE_DIGITS)
