from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from alertloom.models import autoencoder as ae
from alertloom.models import clustering, density, forest, grid_density, reduction, store, thresholds
from alertloom.models.encoding import fit_encoder
from alertloom.models.scorer import as_vectors, ModelSet, add_raw_scores, average_path, dense_rows
from alertloom.operators.frequency import FREQUENCY_COLUMNS
from alertloom.plans.preprocess import engineer
from alertloom.queries import literal
from alertloom.schemas import is_categorical_feature, model_input_columns
from alertloom.storage import scratch_path
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def points(spark):
    """990 clustered rows and 10 far ones (ids from 990)."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (990, 4)), rng.normal(0, 1, (10, 4)) + 25])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")
    return df, x


def test_average_path_of_the_paper():
    assert average_path(256) == pytest.approx(10.244771, abs=1e-6)
    assert average_path(2) == 1.0 and average_path(1) == 0.0


def test_model_input_order():
    names = model_input_columns(["protocol", "same_segment", "src_ip_segment", "threat_level", "event_time_hour", "x"])
    assert names == ["src_ip_segment", "event_time_hour", "same_segment", "protocol", "threat_level"]
    assert is_categorical_feature("same_segment") and not is_categorical_feature("event_time_hour")


def test_full_model_input_has_forty_columns(views):
    columns = model_input_columns(engineer(views.alerts.limit(0)).columns)
    assert len(columns) == 40 and sum(is_categorical_feature(c) for c in columns) == 12
    assert [c for c in columns if c.endswith("_freq")] == [f"{c}_freq" for c in FREQUENCY_COLUMNS]


def test_sample_is_exact_per_tree(spark):
    sample = forest.per_tree_sample(spark.range(10_000), 10_000, trees=10)
    assert {r["tree"]: r["count"] for r in sample.groupBy("tree").count().collect()} == {t: 256 for t in range(10)}
    few = forest.per_tree_sample(spark.range(40), 40, trees=3)
    assert [r["count"] for r in few.groupBy("tree").count().collect()] == [40] * 3


def test_sample_pool_is_bounded_for_large_tables(spark):
    rows = 3_000_000
    pool = forest.per_tree_sample(spark.range(rows), rows, trees=20)
    counts = [r["count"] for r in pool.groupBy("tree").count().collect()]
    assert counts == [256] * 20


def test_forest_ranks_outliers_lowest_and_repeats(points):
    df, _ = points
    first = forest.fit_forest(df, 1000, trees=50)
    table = sorted(map(tuple, first.collect()))
    assert table == sorted(map(tuple, forest.fit_forest(df, 1000, trees=50).collect()))
    assert max(r[7] for r in table) <= 8
    model = ModelSet(lambda d: d, 4, forest.forest_from_nodes(first, 1000))
    scored = add_raw_scores(df, model)
    worst = [r.id for r in scored.orderBy("if_raw").limit(50).collect()]
    assert set(range(990, 1000)) <= set(worst)


def test_tiny_and_constant_inputs_grow_leaves(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0])], "id long, features array<double>")
    fitted = forest.forest_from_nodes(forest.fit_forest(df, 2, trees=3), 2)
    assert fitted.raw_score(np.ones((1, 2))).shape == (1,)


def test_svd_and_pca_match_numpy(points):
    df, x = points
    vectors = df.withColumn("features", array_to_vector("features"))
    v = reduction.truncated_svd(vectors, 4, k=2)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(v.T @ vt[:2].T), np.eye(2), atol=1e-6)
    axes, mean = reduction.pca(vectors, 4, k=2)
    _, _, vc = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(axes.T @ vc[:2].T), np.eye(2), atol=1e-6) and np.allclose(mean, x.mean(axis=0))
    reduced = reduction.add_reduced(vectors, axes, mean).select(vector_to_array("reduced").alias("r")).collect()
    assert np.allclose(np.mean([r.r for r in reduced], axis=0), 0, atol=1e-9)


def test_subspace_iteration_of_sparse_rows(spark):
    """Sparse, empty and dense rows; the energies are the squared singular values."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((400, 60)) < 0.1, rng.normal(0, 1, (400, 60)), 0.0) + np.outer(rng.normal(0, 2, 400), np.arange(60) % 3 == 0)
    x[:5] = 0
    rows = [(Vectors.dense(r) if i % 2 else Vectors.sparse(60, {int(j): float(r[j]) for j in np.flatnonzero(r)}),) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["features"]).repartition(4)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    v, energy = reduction.svd_with_energy(df, 60, k=1)
    assert np.allclose(np.abs(v.T @ vt[:1].T), 1, atol=1e-6) and np.allclose(energy, s[:1] ** 2)
    v, energy = reduction.svd_with_energy(df, 60, k=10, passes=12)
    assert np.allclose(v.T @ v, np.eye(10), atol=1e-9) and np.allclose(energy, s[:10] ** 2, rtol=1e-3)
    product = reduction.gram_product(reduction._stored(df, "features"), v)
    assert np.allclose(product, x.T @ (x @ v))


def test_covariance_of_far_off_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (500, 5)) * [1, 2, 0, 1e-3, 5] + [1e9, 0, 7, -1e6, 1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").repartition(6)
    matrix, mean, n = reduction.covariance(df, 5)
    assert n == 500 and np.allclose(mean, x.mean(axis=0)) and np.allclose(matrix, np.cov(x.T, bias=True), rtol=1e-6, atol=1e-7)
    axes, offset = reduction.reduction_for(df, 5, 2)
    assert offset is not None and np.allclose(axes, reduction.pca(df, 5, 2)[0])
    assert reduction.covariance(df.limit(0), 5)[2] == 0
    sparse = df.withColumn("features", F.array(*[F.lit(0.0)] * 4, F.col("id").cast("double")))
    assert reduction.reduction_for(sparse, 5, 2)[1] is None


def test_two_components_of_four(points):
    df, x = points
    v = reduction.truncated_svd(df.withColumn("features", array_to_vector("features")), 4, k=2)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(v.T @ vt[:2].T), np.eye(2), atol=1e-4)


def test_select_k_finds_the_two_groups(points):
    df, _ = points
    vectors = df.select("id", array_to_vector("features").alias("reduced"))
    k, centres, tried = clustering.kmeans_select_k(vectors, 1000)
    assert k == 2 and centres.shape == (2, 4) and set(tried) == set(range(2, 10))
    assert clustering.kmeans_select_k(vectors.limit(15), 15)[0] == 2


def test_joint_fits_equal_single_ones(spark):
    """All numbers of clusters in one pass give what each gives alone; k and silhouettes are those of plain loops."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.4, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1), (3, 4, 5))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, reduced array<double>").repartition(3)
    k, centres, tried = clustering.kmeans_select_k(df, len(x))
    singles = {n: clustering.kmeans_fit(df, n) for n in range(2, 10)}
    assert k == 4 and np.allclose(centres, singles[4])

    def plain(c):
        own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        out = []
        for i in range(len(x)):
            mine = (own == own[i]) & (np.arange(len(x)) != i)
            a = gap[i, mine].mean() if mine.any() else None
            b = min(gap[i, own == o].mean() for o in set(own.tolist()) - {own[i]})
            out.append(0.0 if a is None else (b - a) / max(a, b))
        return np.mean(out)

    assert tried == pytest.approx({n: plain(c) for n, c in singles.items()})
    own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(centres, [x[own == j].mean(axis=0) for j in range(4)], atol=1e-3)


def test_kmeans_of_few_distinct_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(50)], "id long, reduced array<double>")
    assert sorted(map(tuple, clustering.kmeans_fit(df, 5).tolist())) == [(0.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError, match="no rows"):
        clustering.kmeans_fit(df.limit(0), 2)


def noise_of(x, eps=0.5, least=5):
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    kept = (near & core[None, :]).any(axis=1)
    return {tuple(p): (bool(c), float(k)) for p, c, k in zip(x.tolist(), core, kept, strict=True)}


@pytest.mark.parametrize("dimensions", [1, 2, 6])
@pytest.mark.parametrize("sizes", [(2_000, 20_000), (20, 20_000), (3, 7)])
def test_density_noise_matches_brute_force(spark, monkeypatch, sizes, dimensions):
    """Few points a ball make both levels of pivots; few points a block split balls and questions."""
    monkeypatch.setattr(density, "BALL_POINTS", sizes[0])
    monkeypatch.setattr(density, "BLOCK_POINTS", sizes[1])
    monkeypatch.setattr(density, "PIVOTS", 256 if sizes[0] > 3 else 6)
    rng = np.random.default_rng(11)
    spread = 0.2 + 0.02 * dimensions
    x = np.round(np.vstack([rng.normal(0, spread, (250, dimensions)), rng.normal(4, 0.02, (40, dimensions)), rng.uniform(-2, 6, (120, dimensions)), np.tile([[5.0] * dimensions], (6, 1)), [[5.2] * dimensions]]), 2)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "point array<double>").repartition(3)
    got = density.density_noise(df).collect()
    assert {tuple(r.point): (r.core, r.score) for r in got} == noise_of(x)
    assert sum(r.n for r in got) == len(x) and (dimensions == 1 or 0 < sum(1 for r in got if r.score == 0))


def test_points_without_a_place_are_noise(spark):
    rows = [([0.0, 0.1 * k], k) for k in range(5)] + [([None, 1.0], 5), (None, 6), ([float("nan"), 0.0], 7), ([float("inf"), 0.0], 8)] + [([0.0, 9.0], 9)]
    df = spark.createDataFrame(rows, "at array<double>, id int")
    got = {r.id: r.score for r in density.density_scores(df, "at").collect()}
    assert got == {**dict.fromkeys(range(5), 1.0), **dict.fromkeys(range(5, 10), 0.0)}
    split = {r.id: r.score for r in density.density_scores(df, "at", broadcast_rows=0).collect()}
    assert split == got
    assert density.density_noise(df.limit(0), "at").count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_grid_noise_matches_brute_force(spark, limit):
    rng = np.random.default_rng(11)
    x = np.round(np.vstack([rng.normal(0, 0.3, (150, 2)), rng.uniform(-6, 6, (120, 2)), np.tile([[5.0, 5.0]], (6, 1)), [[5.4, 5.2]]]), 2)
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], "x double, y double")
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= 0.25
    core = near.sum(axis=1) >= 5
    kept = (near & core[None, :]).any(axis=1)
    want = {tuple(p): (bool(c), float(k)) for p, c, k in zip(x.tolist(), core, kept, strict=True)}
    got = grid_density.density_noise(df, ["x", "y"], broadcast_rows=limit).collect()
    assert {(r.x, r.y): (r.core, r.score) for r in got} == want
    assert sum(r.n for r in got) == len(x) and 0 < sum(1 for r in got if r.score == 0)


def test_grid_noise_splits_large_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.uniform(0, 0.3, (400, 2)), rng.uniform(-3, 3, (60, 2))])
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], "x double, y double")
    whole = sorted((r.x, r.score) for r in grid_density.density_noise(df, ["x", "y"]).collect())
    monkeypatch.setattr(grid_density, "CELL_POINTS", 10)
    assert whole == sorted((r.x, r.score) for r in grid_density.density_noise(df, ["x", "y"]).collect())


def test_gradient_matches_differences():
    shapes = ae.layer_shapes(5, 2)
    flat = ae.initial_weights(shapes, 1)
    x = np.random.default_rng(2).normal(size=(7, 5))

    class NoDropout:
        @staticmethod
        def random(shape):
            return np.ones(shape)

    def loss(w):
        layers = ae.unpack(w, shapes)
        z = x
        for i, (a, b) in enumerate(layers):
            z = z @ a + b
            if i in ae.DROPPED_LAYERS:
                z = z / (1 - ae.DROPOUT)
            if i < len(layers) - 1:
                z = np.maximum(z, 0)
        return ((z - x) ** 2).mean()

    grad, value = ae.gradient(x, flat, shapes, NoDropout())
    assert value == pytest.approx(loss(flat))
    for i in range(0, len(flat), 37):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert grad[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-6)


def test_autoencoder_learns_and_stops(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(1200, 2))
    x = z @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")
    df = df.withColumn("features", array_to_vector("features")).repartition(3)
    model, history = ae.fit_autoencoder(df, 6, encoding_dim=4, epochs=8, shard_rows=400)
    assert [h["epoch"] for h in history] == list(range(len(history)))
    assert history[-1]["val_loss"] < history[0]["val_loss"] < 1.2
    best = min(h["val_loss"] for h in history)
    held = [r.id for r in df.where(F.pmod(F.xxhash64("id"), F.lit(5)) == 0).select("id").collect()]
    assert model.error(x[held]).mean() == pytest.approx(best, rel=1e-6)
    assert model.encode(x[:3]).shape == (3, 4)


def test_weights_do_not_depend_on_the_tasks(spark, monkeypatch):
    """One task that reads all shards gives the weights of a task per shard, also with several rounds of averaging."""
    monkeypatch.setattr(ae, "FAN_IN", 3)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 2)) @ rng.normal(size=(2, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").withColumn("features", array_to_vector("features"))

    def fitted(partitions, open_cost):
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
        try:
            return ae.fit_autoencoder(df.repartition(partitions), 5, encoding_dim=3, epochs=3, batch=16, shard_rows=80)
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")

    one, history = fitted(1, "0")
    many, again = fitted(5, "200000000")
    assert history == again
    assert all(np.array_equal(a, b) for x, y in zip(one.layers, many.layers, strict=True) for a, b in zip(x, y, strict=True))


def test_training_stops_without_improvement(spark):
    df = spark.range(60).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("features")).withColumn("features", array_to_vector("features"))
    _, history = ae.fit_autoencoder(df, 2, encoding_dim=2, epochs=8, patience=1, shard_rows=30)
    assert [h["val_loss"] for h in history] == [0.0, 0.0]


def test_dense_rows_mix_sparse_and_dense():
    import pandas as pd

    parts = pd.DataFrame({"indices": [np.array([1, 3]), None, np.array([], dtype=int)], "values": [np.array([5.0, 6.0]), np.array([1.0, 2.0, 3.0, 4.0]), np.array([])]})
    assert dense_rows(parts, 4).tolist() == [[0, 5, 0, 6], [1, 2, 3, 4], [0, 0, 0, 0]]


def test_unseen_category_is_all_zero(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 3)], "protocol string, threat_level int")
    encoder = fit_encoder(seen)
    encoded = encoder(spark.createDataFrame([("b", 2), ("new", None)], seen.schema))
    got = [r[0] for r in as_vectors(encoded).select(vector_to_array("features")).collect()]
    places = {(r.column_name, r.value): (r.place, r.share) for r in encoder.table.collect()}
    assert places == {("protocol", "a"): (0, 0.5), ("protocol", "b"): (1, 0.5)} and encoder.scaler == {"threat_level": (2.0, 1.0)}
    assert sorted(got) == [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0]]


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_very_many_categories(spark, broadcast_rows):
    """More than 50,000 values keep their places in text order, by either way of looking them up."""
    df = spark.range(60_000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("src_ip_segment")).union(spark.range(500).select(F.lit("s7")))
    encoder = fit_encoder(df)
    assert encoder.width == 60_000
    got = {r.v: r.i for r in encoder(df, broadcast_rows).select(F.col("src_ip_segment").alias("v"), F.col("features.indices").getItem(0).alias("i")).collect()}
    assert got == {v: i for i, v in enumerate(sorted(f"s{k}" for k in range(60_000)))}


def test_models_survive_storage(spark, views):
    engineered = engineer(views.alerts)
    encoder = fit_encoder(engineered)
    fixed = literal.literal_models(0.5)
    models = replace(fixed, encode=encoder, width=encoder.width, ranges={"err": (0.0, 2.0)})
    path = scratch_path(spark, "store")
    store.save_models(spark, models, path)
    loaded = store.load_models(spark, path, need=("encoder", "forest", "clusters", "autoencoder"))
    x = np.random.default_rng(1).uniform(0, 12, (20, 3))
    assert (loaded.encode.sizes, loaded.encode.scaler) == (encoder.sizes, encoder.scaler)
    assert sorted(loaded.encode.table.collect()) == sorted(encoder.table.collect())
    assert loaded.ranges == models.ranges and loaded.error_threshold == 0.5
    assert np.array_equal(loaded.forest.raw_score(x), fixed.forest.raw_score(x))
    assert np.allclose(loaded.clusters.distance(x), fixed.clusters.distance(x))
    assert np.allclose(loaded.autoencoder.error(x), fixed.autoencoder.error(x))
    with pytest.raises(store.MissingModel, match="published"):
        store.load_models(spark, path + "-nowhere")
    with pytest.raises(store.MissingModel, match="frequencies"):
        store.load_models(spark, path, need=("frequencies",))
    store.save_models(spark, replace(models, forest=None), path)
    with pytest.raises(store.MissingModel, match="forest"):
        store.load_models(spark, path)
    assert store.load_models(spark, path, number=1).forest is not None
    assert [r.number for r in store.versions(spark, path).orderBy("number").collect()] == [1, 2]


def test_a_failed_save_leaves_the_published_set(spark, monkeypatch):
    """Readers see the old set until the new one is whole."""
    encoder = fit_encoder(spark.createDataFrame([("a", 1), ("b", 3)], "protocol string, threat_level int"))
    models = replace(literal.literal_models(0.5), encode=encoder, width=encoder.width, flag_thresholds={"kmeans": 0.25})
    path = scratch_path(spark, "store")
    store.save_models(spark, models, path)
    rows = store._rows

    def broken(m):
        yield from list(rows(m).items())[:4]
        raise OSError("disk full")

    class Broken:
        def items(self):
            return broken(replace(models, error_threshold=0.9))

    monkeypatch.setattr(store, "_rows", lambda m: Broken())
    with pytest.raises(OSError, match="disk full"):
        store.save_models(spark, models, path)
    loaded = store.load_models(spark, path)
    assert loaded.error_threshold == 0.5 and loaded.flag_thresholds == {"kmeans": 0.25}
    with pytest.raises(store.MissingModel, match="no model set 7"):
        store.published(spark, path, 7)


def test_thresholds(spark):
    df = spark.createDataFrame([(0.15, True), (0.25, True), (0.55, False), (0.95, False)], "s double, y boolean")
    best = thresholds.threshold_by_f1(df, "s", "y").first()
    assert (best.threshold, best.f1) == (0.3, 1.0)
    none = thresholds.threshold_by_f1(df.withColumn("y", F.lit(False)), "s", "y").first()
    assert (none.threshold, none.f1) == (0.8, 0.0)
