"""Exact search for the largest inner products by pivot-table elimination.

Distances of every vector to a few dozen pivots are computed once (the pivot
table). For a query q and a vector x, the triangle inequality over all pivots p
gives |q - x| >= max_p |d(q, p) - d(x, p)|, and with the norms this bounds the
inner product from above: (|q|^2 + |x|^2 - bound^2) / 2. Candidates are evaluated
in the order of that bound until the next bound is below the k-th best score
found, so the result is exact, ties included.

Queries are taken in blocks of bounded size that meet all rows of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.storage import materialise, scratch_path

SCALE = 256
PIVOTS = 32
PIVOT_SAMPLE = 2_000  # rows that pivots are picked from and first thresholds found in
QUERY_BLOCK = 4_096  # queries broadcast at a time
QUERY_STEP = 64  # queries whose bounds are computed together
ROW_STEP = 4_096

TABLE = "vec_id long, parts binary, near binary, floor long"


def quantised(column: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x), x as double; null if the vector takes no part."""
    usable = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first rows of a sample, beginning with its first row."""
    if not len(sample):
        return sample
    points = sample.astype(np.float64)
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integers: doubles while every sum stays below 2**53, else 64-bit integers."""
    if float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, rows.shape[1]) < 2**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return rows @ query


def _rows(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class Best:
    """The k best (score, id) of one query, the smaller id first among equals."""

    def __init__(self, k: int, floor: int | None):
        self.k, self.floor = k, floor  # floor: k rows are known to score this much
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """A row below this cannot be among the k best."""
        own = self.scores[-1] if len(self.scores) == self.k else None
        known = [x for x in (own, self.floor) if x is not None]
        return float(max(known)) if known else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_rows(best: Best, query: np.ndarray, query_id: int, upper: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
    """Evaluates rows in the order of their bounds until no further one can count."""
    open_rows = np.flatnonzero(upper >= best.least)
    open_rows = open_rows[np.argsort(-upper[open_rows], kind="stable")]
    at, step = 0, 32
    while at < len(open_rows) and upper[open_rows[at]] >= best.least:
        now = open_rows[at : at + step]
        scores, numbers = inner_products(rows[now], query), ids[now]
        keep = (scores >= best.least) & (numbers != query_id)
        best.add(scores[keep], numbers[keep])
        at, step = at + step, min(step * 2, 1024)


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = SCALE, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by query_every.

    vectors: vec_id, embedding; other columns are not read. Rows with a null id, a
    null vector or a null or non-finite component take no part. Missing components
    of shorter vectors count as 0. A query's own row is left out, other rows are
    not, equal ones included; repeated rows of one id count once (their largest).
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("parts")).where("vec_id is not null and parts is not null")
    usable = usable.groupBy("vec_id").agg(F.max("parts").alias("parts"))
    width = max(1, usable.agg(F.max(F.size("parts"))).first()[0] or 0)
    drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    sample = np.zeros((len(drawn), width), np.int64)
    for row, values in zip(sample, drawn, strict=True):
        row[: len(values["parts"])] = values["parts"]
    shared = spark.sparkContext.broadcast((pick_pivots(sample, pivots), sample, np.array([r["vec_id"] for r in drawn], np.int64)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, some, some_ids = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, ids = batch.column(1), batch.column(0).to_numpy()
            parts, sizes = np.zeros((batch.num_rows, width), np.int64), lists.value_lengths().to_numpy(zero_copy_only=False)
            parts[np.arange(width)[None] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            near = distances(parts.astype(np.float64), centres)
            # A query's k-th best score within the sample is a first threshold.
            floors: list[int | None] = [None] * len(ids)
            for row in np.flatnonzero(ids % query_every == 0):
                scores = np.sort(inner_products(some, parts[row])[some_ids != ids[row]])
                floors[row] = int(scores[-k]) if len(scores) >= k else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in parts]), pa.array([r.tobytes() for r in near]), pa.array(floors, pa.int64())], ["vec_id", "parts", "near", "floor"])

    table = materialise(usable.mapInArrow(measure, TABLE), "pivot-table")
    centres = len(shared.value[0])
    queries = table.where(F.col("vec_id") % query_every == 0)
    found_path = scratch_path(spark, "found")
    last, schema = None, "query_id long, vec_id long, score long"
    while True:
        block = (queries if last is None else queries.where(F.col("vec_id") > last)).orderBy("vec_id").limit(query_block).toArrow().combine_chunks()
        if not block.num_rows:
            break
        ids = block["vec_id"].to_numpy()
        last = int(ids[-1])
        asked = spark.sparkContext.broadcast((ids, _rows(block["parts"], width, "<i8"), _rows(block["near"], centres, "<f8"), block["floor"].to_pylist()))
        found = table.select("vec_id", "parts", "near").mapInArrow(_searcher(asked, width, centres, k), schema)
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(found_path)
        asked.destroy()
        if block.num_rows < query_block:
            break
    result = "query_id long, rank int, vec_id long, score long"
    return spark.createDataFrame([], result) if last is None else spark.read.schema(result).parquet(found_path)


def _searcher(asked: object, width: int, centres: int, k: int) -> object:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, query_near, floors = asked.value  # type: ignore[attr-defined]
        best = [Best(k, floor) for floor in floors]
        query_norm, query_low = (queries.astype(np.float64) ** 2).sum(axis=1), query_near.astype(np.float32)
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_STEP):
                part = batch.slice(start, ROW_STEP)
                ids, rows = part.column(0).to_numpy(), _rows(part.column(1), width, "<i8")
                near, norm = _rows(part.column(2), centres, "<f8").astype(np.float32), (rows.astype(np.float64) ** 2).sum(axis=1)
                # Single precision errs by a few 1e-7 of a distance; the slack covers it.
                reach = max(float(near.max(initial=0)), float(query_low.max(initial=0)))
                slack = 1e-6 * reach
                columns = np.ascontiguousarray(near.T)
                for first in range(0, len(query_ids), QUERY_STEP):
                    some = slice(first, first + QUERY_STEP)
                    low = np.zeros((len(query_ids[some]), len(ids)), np.float32)
                    gap = np.empty_like(low)
                    for p in range(centres):
                        np.subtract(query_low[some, p][:, None], columns[p][None], out=gap)
                        np.abs(gap, out=gap)
                        np.maximum(low, gap, out=low)
                    bound = np.maximum(0.0, low.astype(np.float64) - slack)
                    upper = (query_norm[some][:, None] + norm[None] - bound**2) / 2 + 1
                    for i, row in enumerate(upper):
                        q = first + i
                        search_rows(best[q], queries[q], int(query_ids[q]), row, rows, ids)
        filled = [(q, b) for q, b in zip(query_ids.tolist(), best, strict=True) if len(b.ids)]
        if filled:
            sizes = [len(b.ids) for _, b in filled]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in filled], sizes)), pa.array(np.concatenate([b.ids for _, b in filled])), pa.array(np.concatenate([b.scores for _, b in filled]))], ["query_id", "vec_id", "score"])

    return search
