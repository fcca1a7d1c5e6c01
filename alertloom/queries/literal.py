"""A small model set with fixed parameters.

Three features, two trees, three centres and a 3-2-3 autoencoder: enough to
check scoring, combination and reports value by value, without fitting.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.models.scorer import Autoencoder, Clusters, Forest, ModelSet, average_path

# Per tree the nodes as (feature, split, left, right, leaf rows, depth).
TREES = [
    [(0, 5.0, 1, 2, 0, 0), (-1, 0.0, 0, 0, 200, 1), (1, 2.0, 3, 4, 0, 1), (-1, 0.0, 0, 0, 40, 2), (-1, 0.0, 0, 0, 16, 2)],
    [(2, 4.0, 1, 2, 0, 0), (0, 10.0, 3, 4, 0, 1), (-1, 0.0, 0, 0, 56, 1), (-1, 0.0, 0, 0, 160, 2), (-1, 0.0, 0, 0, 40, 2)],
]
SAMPLE_SIZE = 256
CENTRES = [(1.0, 1.0), (6.0, 3.0), (12.0, 4.0)]
MEAN, SCALE = (5.0, 2.0, 2.5), (4.0, 2.0, 1.1)
ENCODER = [[0.6, -0.1], [0.4, 0.0], [0.0, 0.9]]
DECODER = [[0.8, 0.7, 0.0], [0.0, 0.1, 0.9]]


def leaf_path(rows: int, depth: int) -> float:
    return float(depth + average_path(rows))


def literal_forest() -> Forest:
    columns: dict[str, list] = {n: [] for n in ("feature", "split", "left", "right", "path")}
    roots = []
    for tree in TREES:
        base = len(columns["feature"])
        roots.append(base)
        for feature, split, left, right, rows, depth in tree:
            columns["feature"].append(feature)
            columns["split"].append(split)
            columns["left"].append(base + left)
            columns["right"].append(base + right)
            columns["path"].append(leaf_path(rows, depth) if feature < 0 else 0.0)
    return Forest(np.array(roots), *[np.array(columns[n]) for n in columns], SAMPLE_SIZE)


def _encode(df: DataFrame) -> DataFrame:
    x1 = F.col("bytes_to_server").cast("double") / 1000
    x2 = F.col("packets_to_server").cast("double") / 100
    x3 = F.col("threat_level").cast("double") / 10
    return df.withColumn("features", F.array(x1, x2, x3))


def literal_models(error_threshold: float | None = None) -> ModelSet:
    return ModelSet(
        encode=_encode,
        width=3,
        forest=literal_forest(),
        clusters=Clusters(np.eye(3)[:, :2], np.array(CENTRES)),
        autoencoder=Autoencoder(
            np.array(MEAN),
            np.array(SCALE),
            [(np.array(ENCODER), np.zeros(2)), (np.array(DECODER), np.zeros(3))],
            code_layer=1,
        ),
        error_threshold=error_threshold,
        uses_frequencies=False,
    )
