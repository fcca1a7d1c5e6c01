"""Noise of a density clustering (DBSCAN), exact, without comparing all pairs.

Points go into grid cells so small that two points of a cell are always within
eps. A cell with at least min_samples points is dense: all its points are core
points and none of them needs a distance. Only points of other cells, fewer
than min_samples per cell, look at neighbouring cells. The cells around one grow with
the power of the dimensions, so this is for two or three; `density` is for more.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.joins import lookup
from alertloom.storage import BROADCAST_ROWS, materialise

EPS, MIN_SAMPLES = 0.5, 5
# Points of one cell that a single join task may meet; larger cells are split.
CELL_POINTS = 20_000


def _cell(columns: list[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(c) / side).cast("bigint") for c in columns])


def _distance_squared(columns: list[str]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + (F.col(f"q_{c}") - F.col(c)) * (F.col(f"q_{c}") - F.col(c))
    return total


def _offsets(dimensions: int) -> list[tuple[int, ...]]:
    """Cells that can hold a point within eps of a point of the cell."""
    reach = math.ceil(math.sqrt(dimensions)) + 1
    near = []
    for step in itertools.product(range(-reach, reach + 1), repeat=dimensions):
        gap = sum(max(abs(s) - 1, 0) ** 2 for s in step)
        if gap <= dimensions:
            near.append(step)
    return near


def _near_pairs(queries: DataFrame, points: DataFrame, cells: DataFrame, columns: list[str], eps: float) -> DataFrame:
    """(query, point) pairs within eps; big cells are split into parts on both sides."""
    steps = F.array(*[F.array(*[F.lit(s).cast("bigint") for s in o]) for o in _offsets(len(columns))])
    renamed = queries.select(*[F.col(c).alias(f"q_{c}") for c in columns], F.col("cell").alias("own"), F.explode(steps).alias("step"))
    wanted = renamed.withColumn("cell", F.zip_with("own", "step", lambda a, b: a + b)).drop("own", "step")
    # Inner join on the occupied cells; each cell has one row there.
    spread = wanted.join(cells.select("cell", "parts"), "cell").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    )
    return spread.join(points, ["cell", "part"]).where(_distance_squared(columns) <= eps * eps)


def density_noise(
    df: DataFrame,
    columns: list[str],
    eps: float = EPS,
    min_samples: int = MIN_SAMPLES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Distinct points with `n` copies, core flag, and score 0 for noise, else 1."""
    side = eps / math.sqrt(len(columns))
    # Copies collapse first: a point held by many rows costs one row per task.
    distinct = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", _cell(columns, side))
    distinct = materialise(distinct, "points")
    cells = distinct.groupBy("cell").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("points"))
    cells = cells.select(
        "cell",
        (F.col("weight") >= min_samples).alias("dense"),
        (F.floor(F.col("points") / CELL_POINTS) + 1).cast("bigint").alias("parts"),
    )
    cells = materialise(cells, "cells")
    points = lookup(distinct, cells, "cell", "cell", broadcast_rows)
    points = points.withColumn("part", F.pmod(F.xxhash64(*columns), F.col("parts")))
    sparse = points.where("NOT dense")

    counts = _near_pairs(sparse, points.select(*columns, "n", "cell", "part"), cells, columns, eps)
    counts = counts.groupBy(*[f"q_{c}" for c in columns]).agg((F.sum("n") >= min_samples).alias("core"))
    judged = sparse.join(counts, [sparse[c].eqNullSafe(counts[f"q_{c}"]) for c in columns], "left")
    judged = judged.select(*columns, "n", "cell", "part", F.coalesce("core", F.lit(False)).alias("core"))
    flagged = materialise(
        points.where("dense").select(*columns, "n", "cell", "part", F.lit(True).alias("core")).unionByName(judged), "core"
    )

    rest = flagged.where("NOT core")
    touched = _near_pairs(rest, flagged.where("core").select(*columns, "cell", "part"), cells, columns, eps)
    touched = touched.select(*[F.col(f"q_{c}").alias(c) for c in columns]).distinct().withColumn("touched", F.lit(1))
    border = rest.join(touched, columns, "left")
    labelled = flagged.where("core").select(*columns, "n", "core", F.lit(1.0).alias("score")).unionByName(
        border.select(*columns, "n", "core", F.coalesce("touched", F.lit(0)).cast("double").alias("score"))
    )
    return labelled


def density_scores(df: DataFrame, columns: list[str], eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Rows of df with their score; defined for the fitted rows only."""
    keyed = df.withColumn("_point", F.struct(*columns))
    labels = density_noise(df, columns, eps, min_samples).select(F.struct(*columns).alias("_point"), "score")
    labels = materialise(labels, "density")
    return lookup(keyed, labels, "_point", "_point").drop("_point")
