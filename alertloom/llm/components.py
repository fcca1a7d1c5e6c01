"""Connected components by local contraction and alternating star contraction.

Every task first contracts the edges it holds into stars around their least ids, so
most edges go without a shuffle. Tasks hold about TASK_EDGES edges: what fits one task
is done then. Else large stars hand every larger neighbour of a node to the node's
smallest neighbour and small stars do the same with the smaller ones, a node's
neighbours being reduced to their minimum before they meet, and the tasks contract
again what is left, until all edges are stars around the smallest id of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.storage import materialise

TASK_EDGES = 1_000_000  # edges that a task contracts together


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the edges (a, b) and the least id that each reaches."""
    names, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    label = np.arange(len(names))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return names, names[label]


def contract(edges: DataFrame, roots: bool = False) -> DataFrame:
    """The edges (a, b) of each task as stars (a, its least reachable b); with (b, b) too if roots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, 0

        def stars() -> np.ndarray:
            both = np.concatenate(held, axis=1)
            return np.stack(least_reachable(*both))

        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(k).to_numpy()) for k in (0, 1)]))
            size += batch.num_rows
            if size > last + TASK_EDGES:
                held = [stars()]
                size = last = held[0].shape[1]
        if held:
            a, b = stars()
            keep = np.full(len(a), True) if roots else a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return edges.mapInArrow(work, "a long, b long")


def _star(edges: DataFrame, minima: DataFrame, large: bool) -> DataFrame:
    """Edges (node, other) with both ends joined to the least id next to node."""
    joined = edges.join(minima, "node")
    if large:
        return joined.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    smaller = joined.where("other < node")
    return smaller.where("other <> least").select(F.col("other").alias("a"), F.col("least").alias("b")).union(minima.where("least < node").select(F.col("node").alias("a"), F.col("least").alias("b")))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))


def _descending(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _star_round(pairs: DataFrame) -> DataFrame:
    # Large star: over the neighbours on both sides and the node itself.
    edges = _both_ways(pairs)
    minima = materialise(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")), "minima")
    grown = materialise(_star(edges, minima, True).where("a <> b").distinct(), "large-star")
    # Small star: over the smaller neighbours; a is the larger end of each edge.
    edges = grown.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    minima = materialise(edges.groupBy("node").agg(F.min("other").alias("least")), "minima")
    return materialise(_descending(_star(edges, minima, False)).distinct(), "small-star")


def _settled(pairs: DataFrame) -> bool:
    """Whether every larger end has one smaller one that is no larger end itself."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(pairs.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    ups = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not ups.where("ups > 1 or (ups = 1 and least = 0)").limit(1).count()


def components(pairs: DataFrame) -> DataFrame:
    """node, component (the least id reachable) for every id in pairs (a, b), stored.

    Rows with a = b name no node by themselves; repeated pairs count once.
    """
    edges = materialise(contract(_descending(pairs.select(F.col("a").cast("long"), F.col("b").cast("long")))), "edges")
    while True:
        tasks = edges.count() // TASK_EDGES + 1
        if tasks == 1:
            return materialise(contract(edges.coalesce(1), roots=True).select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
        edges = materialise(_descending(contract(edges.coalesce(tasks))).distinct(), "stars")
        if _settled(edges):
            least = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(least), "components")
        edges = _star_round(edges)
