"""Score arithmetic: batch normalisation, combination, percentages.

Batch statistics come as one-row scalar subqueries, so normalising never needs
a window over the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-10


@dataclass(frozen=True)
class BatchRange:
    """Least value, greatest value and row count of a score in a batch."""

    low: Column
    high: Column
    rows: Column


def batch_range(df: DataFrame, column: str) -> BatchRange:
    """Range of `column` over the batch, read by one scalar subquery."""
    stats = df.agg(
        F.struct(
            F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("rows")
        ).alias("stats")
    ).scalar()
    return BatchRange(stats.getField("low"), stats.getField("high"), stats.getField("rows"))


def frozen_range(low: float, high: float, rows: int = 2) -> BatchRange:
    """A range fixed at training time, for scoring row by row on streams."""
    return BatchRange(F.lit(float(low)), F.lit(float(high)), F.lit(int(rows)))


def minmax_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """min and max per column in one row."""
    parts = [(F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")) for c in columns]
    return df.agg(*[x for pair in parts for x in pair])


def _within_unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def minmax_normalise(x: Column, r: BatchRange) -> Column:
    """To [0, 1], greater stays greater; a batch of one row gets 0.5.

    Values outside a frozen range get its nearer end.
    """
    return F.when(r.rows > 1, _within_unit((x - r.low) / (r.high - r.low + EPSILON))).otherwise(F.lit(0.5))


def inverse_minmax(x: Column, r: BatchRange) -> Column:
    """To [0, 1] turned round; one row or a constant gets 0.5."""
    return F.when((r.rows > 1) & (r.high > r.low), _within_unit(1 - (x - r.low) / (r.high - r.low + EPSILON))).otherwise(F.lit(0.5))


def recon_normalise(x: Column, r: BatchRange, threshold: Column) -> Column:
    """Reconstruction error to [0, 1]; constant 0; one row is judged by the threshold."""
    single = F.when(x > threshold, F.lit(1.0)).otherwise(x / threshold)
    return F.when(r.rows == 1, single).when(r.high > r.low, _within_unit((x - r.low) / (r.high - r.low))).otherwise(F.lit(0.0))


def anomaly_score(forest: Column, kmeans: Column) -> Column:
    return forest * 0.6 + kmeans * 0.4


# Weights of the novelty score and its floor for outside sources.
RECON_WEIGHT, BASE_WEIGHT, EXTERNAL_FLOOR = 0.7, 0.3, 0.7


def zero_day_score(recon: Column, forest: Column, kmeans_distance: Column, external: Column, fix_polarity: bool = False) -> Column:
    """Weighted novelty score with a floor for sources outside the network.

    The forest score enters high-is-normal, as the established scores do;
    `fix_polarity` turns it round.
    """
    forest_part = 1 - forest if fix_polarity else forest
    score = RECON_WEIGHT * recon + BASE_WEIGHT * (forest_part + kmeans_distance) / 2
    return F.when(external, F.greatest(F.lit(EXTERNAL_FLOOR), score)).otherwise(score)


def percentage(part: Column, total: Column) -> Column:
    return F.round(100 * part / F.greatest(total, F.lit(1)), 2)


def clamp_difference(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), a - b)
