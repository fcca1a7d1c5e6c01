from __future__ import annotations

import numpy as np
import pytest
from alertloom.llm import pivot_search

SCHEMA = "vec_id long, embedding array<float>, label int, score string, parts string"


def brute(rows, k, every):
    usable = {}
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        usable.setdefault(vec_id, []).append([int(np.floor(256 * float(np.float32(x)))) for x in vector])
    usable = {i: max(v) for i, v in usable.items()}
    out = []
    for q, x in usable.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in usable.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 4096])
def test_search_equals_brute_force(spark, block):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + draw.normal(size=8) * 0.1).astype(float).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, rows[0][1]), (50, rows[50][1]), (2200, []), (2201, rows[7][1][:3])]
    df = spark.createDataFrame([(i, v, 0, "own", "own") for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in pivot_search.top_k(df, k=5, pivots=7, query_block=block).collect())
    assert got == brute(rows, 5, 50)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (7, [3.0, 3.0])]
    df = spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in pivot_search.top_k(df).collect()) == brute(rows, 5, 50)
    assert pivot_search.top_k(df.limit(0)).collect() == []
    assert pivot_search.top_k(df.where("vec_id = 7")).collect() == []


def test_pivots_prune(monkeypatch):
    draw = np.random.default_rng(1)
    rows = np.concatenate([draw.integers(-5, 5, (500, 4)) + c for c in ([0, 0, 0, 0], [400, 0, 0, 0])]).astype(np.int64)
    centres = pivot_search.pick_pivots(rows, 4)
    near, query = pivot_search.distances(rows.astype(float), centres), rows[700]
    low = np.abs(near - near[700]).max(axis=1)
    upper = ((query**2).sum() + (rows**2).sum(axis=1) - low**2) / 2 + 1
    seen = []
    real = pivot_search.inner_products
    monkeypatch.setattr(pivot_search, "inner_products", lambda r, q: seen.append(len(r)) or real(r, q))
    best = pivot_search.Best(3, None)
    pivot_search.search_rows(best, query, 700, upper, rows, np.arange(1000))
    assert sum(seen) < 700  # the far cluster is never evaluated
    want = sorted((-int(s), i) for i, s in enumerate(rows @ query) if i != 700)[:3]
    assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want


def test_large_components_stay_exact():
    rows = np.array([[1 << 30, -(1 << 30)], [3, 5]], np.int64)
    query = np.array([(1 << 30) + 1, 7], np.int64)
    assert pivot_search.inner_products(rows, query).tolist() == [int(a) * ((1 << 30) + 1) + int(b) * 7 for a, b in rows.tolist()]
