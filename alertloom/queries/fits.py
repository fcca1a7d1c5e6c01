"""Registered queries: fits over the whole tables, and density noise."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions import scores
from alertloom.functions.traffic import fill_missing
from alertloom.models import autoencoder as ae
from alertloom.models import clustering, density, forest, grid_density, reduction, scorer, store
from alertloom.models.encoding import Encoder, fit_encoder, scaler_stats, standardise
from alertloom.models.scorer import ModelSet, add_raw_scores
from alertloom.plans import detect, train
from alertloom.plans.preprocess import engineer
from alertloom.queries.features import ENGINEERED_CTES, engineered_ctes, internal_sql
from alertloom.queries.registry import Query, checked
from alertloom.schemas import CATEGORICAL_COLUMNS, DETECTION_THRESHOLD, FREQUENCY_COLUMNS, IP_COLUMNS, NUMERIC_COLUMNS, PORT_COLUMNS, TIME_COLUMNS, is_categorical_feature, model_input_columns
from alertloom.sources.views import Views
from alertloom.storage import materialise, scratch_path, spread

# Columns of the engineered frame that features are chosen from.
_ENGINEERED_COLUMNS = [
    *[f"{c}_{part}" for c in IP_COLUMNS for part in ("is_internal", "segment")],
    *[f"{c}_{part}" for c in PORT_COLUMNS for part in ("service", "is_common")],
    *[f"{c}_{part}" for c in TIME_COLUMNS for part in ("hour", "day", "weekday", "is_work_hour")],
    *[f"{c}_freq" for c in FREQUENCY_COLUMNS],
    *["same_segment", "total_bytes", "total_packets", "avg_packet_size"],
    *CATEGORICAL_COLUMNS,
    *NUMERIC_COLUMNS,
]

def _encoded(v: Views) -> tuple[DataFrame, Encoder]:
    engineered = materialise(engineer(spread(v.alerts)), "engineered")
    encoder = fit_encoder(engineered)
    return materialise(encoder(engineered), "encoded"), encoder


def _positions(encoder: Encoder) -> Column:
    """Set positions of the one-hot part, as text per row, from `_parts`."""
    ones = sum(encoder.sizes.values())
    where, values = F.col("_parts.indices"), F.col("_parts.values")
    sparse = F.filter(where, lambda i: i < ones)
    dense = F.array_compact(F.transform(F.slice(values, 1, ones), lambda x, i: F.when(x != 0, i)))
    return F.array_join(F.when(where.isNull(), dense).otherwise(sparse), ",")


def _entry(place: int) -> Column:
    """One entry of the vector in `_parts`."""
    where, values = F.col("_parts.indices"), F.col("_parts.values")
    stored = F.coalesce(F.try_element_at(F.map_from_arrays(where, values), F.lit(place)), F.lit(0.0))
    return F.when(where.isNull(), F.get(values, F.lit(place))).otherwise(stored)


def _with_parts(encoded: DataFrame) -> DataFrame:
    return encoded.select("id", scorer.vector_parts(encoded, "features").alias("_parts"))


def _onehot(v: Views) -> DataFrame:
    rows = fill_missing(v.alerts).select("id", *CATEGORICAL_COLUMNS)
    encoder = fit_encoder(rows)
    return _with_parts(encoder(rows)).select("id", _positions(encoder).alias("positions"))


def _ranks_sql(source: str, columns: list[str]) -> tuple[str, str]:
    """(expression for the set positions, CTEs with the place of every value)."""
    ranks, tables, joins, offset = [], [], [], "0"
    for c in columns:
        tables.append(
            f"t_{c} AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM (SELECT DISTINCT cast({c} as varchar) AS value FROM {source}))"
        )
        joins.append(f"JOIN t_{c} ON t_{c}.value = cast({source}.{c} as varchar)")
        ranks.append(f"cast(t_{c}.i + {offset} as varchar)")
        offset += f" + (SELECT count(*) FROM t_{c})"
    tables.append(f"total AS (SELECT {offset} AS ones)")
    joined = ", ',', ".join(ranks)
    tables.append(f"placed AS (SELECT {source}.id, concat({joined}) AS positions FROM {source} {' '.join(joins)})")
    return "SELECT id, positions FROM placed", ", ".join(tables)


def _onehot_sql() -> tuple[str, str]:
    filled = ", ".join(f"coalesce({c}, 'unknown') AS {c}" for c in CATEGORICAL_COLUMNS)
    select, ctes = _ranks_sql("f", CATEGORICAL_COLUMNS)
    return select, f"f AS (SELECT id, {filled} FROM alerts), {ctes}"


# The standardised numbers, all of them, and their SQL; `+ 0.0` makes a negative zero a plain one.
NUMBERS = [c for c in model_input_columns(_ENGINEERED_COLUMNS) if not is_categorical_feature(c)]
_Z_SQL = ", ".join(
    f"coalesce(round((e.{c} - avg(e.{c}) OVER ()) / CASE WHEN stddev_pop(e.{c}) OVER () > 0 THEN stddev_pop(e.{c}) OVER () ELSE 1 END, 6), 0e0) + 0e0 AS {c}" for c in NUMBERS
)
SCALED_CTES = f"{engineered_ctes(rounded=False)}, scaled AS (SELECT e.id, {_Z_SQL} FROM engineered e)"


def _scaled(v: Views) -> DataFrame:
    """id and all numbers, standardised, at six decimals."""
    engineered = materialise(engineer(v.alerts), "engineered")
    stats = scaler_stats(engineered, NUMBERS)
    return engineered.select("id", *[(F.round(standardise(c, *stats[c]), 6) + F.lit(0.0)).alias(c) for c in NUMBERS])


def _assemble(v: Views) -> DataFrame:
    """Width, one-hot positions and the last five scaled numbers of every vector."""
    engineered = materialise(engineer(v.alerts), "engineered")
    encoder = fit_encoder(engineered)
    width = encoder.width
    last = [F.round(_entry(width - len(NUMERIC_COLUMNS) + i), 6).alias(c) for i, c in enumerate(NUMERIC_COLUMNS)]
    rows = _with_parts(encoder(engineered))
    return rows.select("id", F.lit(width).alias("width"), _positions(encoder).alias("positions"), *last)


def _assemble_sql() -> tuple[str, str]:
    columns = [*[f"{c}_segment" for c in IP_COLUMNS], *[f"{c}_service" for c in PORT_COLUMNS], "same_segment", *CATEGORICAL_COLUMNS]
    _, ctes = _ranks_sql("engineered", columns)
    scaled = ", ".join(f"round((e.{c} - avg(e.{c}) OVER ()) / stddev_pop(e.{c}) OVER (), 6) AS {c}" for c in NUMERIC_COLUMNS)
    numbers = len(model_input_columns(_ENGINEERED_COLUMNS)) - len(columns)
    select = f"SELECT id, cast((SELECT ones FROM total) + {numbers} as int) AS width, positions, {scaled} FROM placed JOIN engineered e USING (id)"
    return select, f"{ENGINEERED_CTES}, {ctes}"


def _svd(v: Views) -> DataFrame:
    """Per component: is it of length 1 and square to the others, does its singular value
    equal the length of its column of the reduced rows? Beside the energy of all rows."""
    encoded, encoder = _encoded(v)
    axes, energy = reduction.svd_with_energy(encoded, encoder.width)
    reduced = reduction.add_reduced(encoded.select("id", "features"), axes).select(vector_to_array("reduced").alias("r"))
    sums = reduced.agg(*[F.sum(F.get("r", F.lit(j)) ** 2).alias(f"s{j}") for j in range(len(energy))]).first()
    total = _with_parts(encoded).agg(F.sum(F.aggregate("_parts.values", F.lit(0.0), lambda t, x: t + x * x)).alias("t")).first()["t"]
    dots = axes.T @ axes - np.eye(len(energy))
    rows = []
    for j, e in enumerate(energy):
        falling = j == 0 or e <= energy[j - 1]
        rows.append((j, bool(np.abs(dots[j]).max() < 1e-9), bool(abs(sums[f"s{j}"] - e) <= 1e-6 * e and falling), bool(energy.sum() <= total * (1 + 1e-9))))
    found = v.spark.createDataFrame(rows, "component int, orthonormal boolean, energy_of_rows boolean, within_total boolean")
    return found.withColumn("total_energy", F.round(F.lit(float(total)), 2))


def _svd_sql() -> tuple[str, str]:
    cats = len(model_input_columns(_ENGINEERED_COLUMNS)) - len(NUMBERS)
    energy = " + ".join(f"sum({c} * {c})" for c in NUMBERS)
    z = ", ".join(
        f"coalesce((e.{c} - avg(e.{c}) OVER ()) / CASE WHEN stddev_pop(e.{c}) OVER () > 0 THEN stddev_pop(e.{c}) OVER () ELSE 1 END, 0e0) AS {c}" for c in NUMBERS
    )
    select = f"SELECT cast(r.range as int) AS component, true AS orthonormal, true AS energy_of_rows, true AS within_total, t.e AS total_energy FROM range(10) r, (SELECT round(count(*) * {cats} + {energy}, 2) AS e FROM z) t"
    return select, f"{engineered_ctes(rounded=False)}, z AS (SELECT {z} FROM engineered e)"


def _pca(v: Views) -> DataFrame:
    """The covariance of all scaled numbers, put together again from all principal axes and their variances."""
    scaled = _scaled(v)
    dense = materialise(scaled.select("id", F.array(*NUMBERS).alias("features")), "dense-rows")
    axes, variance = reduction.axes_of(reduction.covariance(dense, len(NUMBERS))[0], len(NUMBERS))
    back = (axes * variance) @ axes.T
    rows = [(a, b, float(back[i, j])) for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if i <= j]
    return v.spark.createDataFrame(rows, "a string, b string, covariance double").withColumn("covariance", F.round("covariance", 4) + F.lit(0.0))


def _pca_sql() -> tuple[str, str]:
    pairs = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]
    wide = ", ".join(f"covar_pop({a}, {b}) AS c{k}" for k, (a, b) in enumerate(pairs))
    listed = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'c': c{k}}}" for k, (a, b) in enumerate(pairs))
    return "SELECT x.a AS a, x.b AS b, round(x.c, 4) + 0e0 AS covariance FROM (SELECT unnest(l) AS x FROM listed)", f"{SCALED_CTES}, sums AS (SELECT {wide} FROM scaled), listed AS (SELECT [{listed}] AS l FROM sums)"


def _sample_counts(v: Views) -> DataFrame:
    rows = v.alerts.count()
    sample = forest.per_tree_sample(v.alerts.select("id"), rows)
    return sample.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


def _forest_nodes(v: Views) -> DataFrame:
    """Per tree: its roots, rows of all leaves together, and whether every node
    splits into two deeper ones within the depth limit."""
    encoded, _ = _encoded(v)
    nodes = materialise(forest.fit_forest(encoded, encoded.count()), "forest-nodes")
    leaf = F.col("feature") < 0
    sums = nodes.groupBy("tree").agg(
        F.sum(F.when(leaf, F.col("size"))).alias("leaf_rows"),
        (F.max("depth") <= 8).alias("depth_kept"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("two_ways"),
        F.sum(F.when(F.col("depth") == 0, 1)).alias("roots"),
    )
    return sums.select("tree", "roots", "leaf_rows", "depth_kept", "two_ways")


def _reduced(v: Views) -> DataFrame:
    encoded, encoder = _encoded(v)
    return _reduced_of(encoded, encoder)[0]


def _reduced_of(encoded: DataFrame, encoder: Encoder) -> tuple[DataFrame, np.ndarray, np.ndarray | None]:
    projection, offset = reduction.reduction_for(encoded, encoder.width)
    return materialise(reduction.add_reduced(encoded.select("id", "features"), projection, offset).select("id", "reduced"), "reduced"), projection, offset


def _kmeans(v: Views) -> DataFrame:
    """Clusters and their rows; is every centre the mean of the rows nearest to it?"""
    reduced = _reduced(v)
    centres = clustering.kmeans_fit_all(reduced, [clustering.DEFAULT_K])[clustering.DEFAULT_K]
    point = vector_to_array("reduced")
    gaps = F.array(*[F.struct(sum(((F.get("p", F.lit(d)) - F.lit(float(x))) ** 2 for d, x in enumerate(c)), F.lit(0.0)).alias("gap"), F.lit(k).alias("k")) for k, c in enumerate(centres)])
    own = reduced.select(point.alias("p")).withColumn("k", F.array_min(gaps)["k"])
    means = own.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.get("p", F.lit(d))).alias(f"m{d}") for d in range(centres.shape[1])]).collect()
    apart = max(abs(r[f"m{d}"] - x) for r in means for d, x in enumerate(centres[r["k"]]))
    scale = float(np.abs(centres).max())
    return v.spark.createDataFrame([(len(means), sum(r["n"] for r in means), bool(apart <= 0.02 * scale))], "clusters int, rows long, centres_are_means boolean")


def _select_k(v: Views) -> DataFrame:
    """The numbers of clusters tried; is each silhouette one, and the chosen number the first of the best?"""
    reduced = _reduced(v)
    best, centres, tried = clustering.kmeans_select_k(reduced, reduced.count())
    chosen = bool(best == min(k for k in tried if tried[k] == max(tried.values())) and len(centres) == best)
    return v.spark.createDataFrame([(k, bool(-1 <= s <= 1), chosen) for k, s in tried.items()], "k int, silhouette_in_range boolean, best_is_chosen boolean")


def _fit_small(v: Views) -> tuple[DataFrame, ModelSet, list[dict[str, float]]]:
    encoded, encoder = _encoded(v)
    fitted, history = ae.fit_autoencoder(encoded, encoder.width)
    return encoded, ModelSet(encoder, encoder.width, autoencoder=fitted), history


def _autoencoder(v: Views) -> DataFrame:
    """Does the held-out loss fall, and do the kept weights have the least one?"""
    _, _, history = _fit_small(v)
    held = [h["val_loss"] for h in history]
    row = (1 <= len(history) <= ae.EPOCHS, bool(min(held) < held[0]), bool(np.isfinite(held).all()), len(held) - 1 - int(np.argmin(held)) <= ae.PATIENCE)
    return v.spark.createDataFrame([row], "epochs_within boolean, held_out_falls boolean, finite boolean, stops_in_time boolean")


def _codes(v: Views) -> DataFrame:
    """Length of every row's code, and whether its entries are outputs of a rectifier."""
    encoded, models, _ = _fit_small(v)
    sound = F.forall("code", lambda x: (x >= 0) & (x < float("inf")))
    return scorer.encode_features(encoded, models).select("id", F.size("code").alias("code_size"), sound.alias("sound"))


def _rebuilt(v: Views) -> DataFrame:
    """Rows of the sample whose error is that of their input against its reconstruction."""
    encoded, models, _ = _fit_small(v)
    gap = F.aggregate(F.zip_with("original", "reconstructed", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x) / F.size("original")
    return scorer.reconstruction_sample(encoded, models).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(gap - F.col("error")) <= 1e-9 * F.greatest(gap, F.lit(1.0))).alias("consistent"))


def _plane(v: Views) -> DataFrame:
    """Points and centres in the plane; flagged by the fitted forest, at most the assumed share."""
    done = train.train_baseline(v.alerts, None, as_of=v.as_of_event, k=clustering.DEFAULT_K)
    models = done.frozen
    encoded = materialise(models.encode(engineer(spread(v.alerts), frozen=models.frequencies)), "encoded")
    raw = add_raw_scores(encoded, models).withColumn("score", scores.minmax_normalise(F.col("if_raw"), scores.frozen_range(*models.ranges["if_raw"])))
    flagged = raw.withColumn("is_anomaly", F.col("score") < models.flag_thresholds["isolation_forest"])
    plane = materialise(scorer.projection_2d(flagged, models), "plane")
    return plane.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pc1").isNull() | F.col("pc2").isNull()).alias("unplaced"), (F.count_if("is_anomaly") * 2 <= F.count(F.lit(1))).alias("few_flagged"))


def _train_baseline(v: Views) -> DataFrame:
    """Per model the rows it was trained on, its features, and whether it flags the assumed share of them."""
    report = train.train_baseline(v.alerts, v.baseline, as_of=v.as_of_event).reports["models"]
    share = F.create_map(*[x for m, c in train.CONTAMINATION.items() for x in (F.lit(m), F.lit(c))])
    most = F.floor(F.col("data_count") * F.element_at(share, F.col("model")))
    numbers = (F.col("feature_dim") > len(NUMBERS)).alias("has_categories")
    return report.select("model", "data_count", numbers, ((F.col("anomaly_count") <= most) & (F.col("anomaly_count") > 0)).alias("flags_the_share"))


def _train_zero_day(v: Views) -> DataFrame:
    """Rows of the baseline above the error threshold: the assumed twentieth, and whether the loss falls."""
    encoded, encoder = _encoded(v)
    done = train.train_zero_day(v.baseline, ModelSet(encoder, encoder.width))
    losses = [r["val_loss"] for r in done.reports["losses"].orderBy("epoch").collect()]
    over = F.count_if(F.col("err") > F.lit(done.models.error_threshold))
    counts = done.scored.agg(F.count(F.lit(1)).alias("rows"), (over <= F.ceil(F.count(F.lit(1)) * 0.05)).alias("a_twentieth_above"))
    return counts.withColumn("held_out_falls", F.lit(bool(min(losses) < losses[0])))


def _fitted(v: Views) -> ModelSet:
    """All models, fitted on the alerts and the baseline, stored and read back."""
    path = scratch_path(v.spark, "models")
    first = train.run_baseline_training(v.alerts, v.baseline, path, scratch_path(v.spark, "state"), v.as_of_event, k=clustering.DEFAULT_K)
    train.run_zero_day_training(v.baseline, first.models, path, scratch_path(v.spark, "state"), v.as_of_event, epochs=10)
    return store.load_models(v.spark, path, need=("encoder", "forest", "clusters", "autoencoder", "frequencies"))


def _model_tables(v: Views) -> DataFrame:
    """Alerts that score alike with the stored set and with the one it was stored from, and whether streams take it."""
    path = scratch_path(v.spark, "models")
    first = train.run_baseline_training(v.alerts, v.baseline, path, scratch_path(v.spark, "state"), v.as_of_event, k=clustering.DEFAULT_K)
    fitted = train.run_zero_day_training(v.baseline, first.models, path, scratch_path(v.spark, "state"), v.as_of_event, epochs=3).models
    loaded = store.load_models(v.spark, path, need=("encoder", "forest", "clusters", "autoencoder", "frequencies"))
    encoded = materialise(fitted.encode(engineer(spread(v.alerts), frozen=fitted.frequencies)).select("id", "features"), "encoded")
    again = materialise(loaded.encode(engineer(spread(v.alerts), frozen=loaded.frequencies)).select("id", "features"), "encoded-again")
    left, right = (materialise(add_raw_scores(x, m).select("id", "if_raw", "km_raw", "err"), "raw").alias(n) for x, m, n in ((encoded, fitted, "a"), (again, loaded, "b")))
    same = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1e-9 * (1 + F.abs(F.col(f"a.{c}")))
    both = left.join(right, "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~(same("if_raw") & same("km_raw") & same("err"))).alias("differing"))
    kept = loaded.flag_thresholds == fitted.flag_thresholds and loaded.error_threshold == fitted.error_threshold and loaded.ranges == fitted.ranges
    return both.withColumns({"thresholds_kept": F.lit(bool(kept)), "fit_for_streams": F.lit(loaded.frozen)})


def _detect_fitted(v: Views) -> DataFrame:
    """Detection with fitted models: every alert once, and how its flags and score follow from its own figures."""
    models = _fitted(v)
    found = materialise(detect.detect_zero_day(v.alerts, models), "detected-fitted")
    limit = float(models.error_threshold)
    external = F.col("src_ip_is_internal") == 0
    baseline = (F.round("isolation_forest_score", 6) < DETECTION_THRESHOLD) | (F.round(1 - F.col("kmeans_distance"), 6) < DETECTION_THRESHOLD)
    candidate = F.round("reconstruction_error", 6) > F.round(F.lit(limit), 6)
    flag = (baseline & candidate) | external
    inside = lambda c: F.col(c).between(0, 1)
    return found.select(
        "id",
        F.col("src_ip_is_internal"),
        (F.col("is_baseline_anomaly") == baseline).alias("baseline_flag_follows"),
        (F.col("is_zero_day_candidate") == candidate).alias("candidate_flag_follows"),
        (F.col("is_zero_day") == flag).alias("flag_follows"),
        (inside("isolation_forest_score") & inside("kmeans_distance") & inside("zero_day_score")).alias("scores_in_range"),
        (~external | (F.col("is_zero_day") & (F.col("zero_day_score") >= scores.EXTERNAL_FLOOR))).alias("external_is_novel"),
    )


# Two alerts are near if all their numbers together are less than this apart.
_NEAR = 2.0


def _density(v: Views) -> DataFrame:
    rows = _scaled(v).select("id", F.array(*NUMBERS).alias("point"))
    return density.density_scores(rows, "point", eps=_NEAR).select("id", "score")


_WHERE = f"[{', '.join(NUMBERS)}]::DOUBLE[{len(NUMBERS)}]"
_DENSITY_CTES = (
    f"{SCALED_CTES}, spots AS (SELECT id, {_WHERE} AS x FROM scaled), pt AS (SELECT x, count(*) AS n FROM spots GROUP BY x), "
    f"near AS (SELECT a.x, b.x AS y, b.n FROM pt a JOIN pt b ON array_distance(a.x, b.x) <= {_NEAR}), "
    "core AS (SELECT x FROM near GROUP BY x HAVING sum(n) >= 5), "
    "kept AS (SELECT DISTINCT near.x FROM near JOIN core ON core.x = y)"
)


_POINT = "cast(bytes_to_server as double) / 1000 AS x1, cast(packets_to_server as double) / 100 AS x2"


def _grid(v: Views) -> DataFrame:
    """Noise by two figures: so few dimensions take the grid."""
    rows = v.alerts.select(
        "id",
        (F.col("bytes_to_server").cast("double") / 1000).alias("x1"),
        (F.col("packets_to_server").cast("double") / 100).alias("x2"),
    )
    return grid_density.density_scores(rows, ["x1", "x2"]).select("id", "score")


_GRID_CTES = (
    f"pt AS (SELECT x1, x2, count(*) AS n FROM (SELECT {_POINT} FROM alerts) GROUP BY x1, x2), "
    "near AS (SELECT a.x1, a.x2, b.x1 AS y1, b.x2 AS y2, b.n FROM pt a JOIN pt b ON b.x1 BETWEEN a.x1 - 0.5 AND a.x1 + 0.5 AND (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) <= 0.25), "
    "core AS (SELECT x1, x2 FROM near GROUP BY x1, x2 HAVING sum(n) >= 5), "
    "kept AS (SELECT DISTINCT near.x1, near.x2 FROM near JOIN core ON core.x1 = y1 AND core.x2 = y2)"
)


def _density_reduced(v: Views) -> DataFrame:
    """Noise among the reduced rows: rows scored, and scores that are none or differ between equal rows."""
    reduced = _reduced(v).select("id", vector_to_array("reduced").alias("point"))
    scored = materialise(density.density_scores(reduced, "point"), "density-reduced")
    unequal = scored.groupBy("point").agg(F.count_distinct("score").alias("kinds")).agg(F.count_if(F.col("kinds") > 1).alias("unequal_copies"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("score").isin(0.0, 1.0) | F.col("score").isNull()).alias("unscored")).join(F.broadcast(unequal))


def queries() -> dict[str, Query]:
    return {
        "onehot": checked(_onehot, *_onehot_sql()),
        "standardise": checked(_scaled, "SELECT * FROM scaled", SCALED_CTES),
        "assemble": checked(_assemble, *_assemble_sql()),
        "truncated_svd": checked(_svd, *_svd_sql()),
        "pca": checked(_pca, *_pca_sql()),
        "per_tree_sample": checked(
            _sample_counts,
            "SELECT cast(range as int) AS tree, least(256, (SELECT count(*) FROM alerts)) AS n, least(256, (SELECT count(*) FROM alerts)) AS n_ids FROM range(100)",
        ),
        "iforest_fit": checked(
            _forest_nodes,
            "SELECT cast(range as int) AS tree, 1::BIGINT AS roots, least(256, c.n)::BIGINT AS leaf_rows, true AS depth_kept, true AS two_ways FROM range(100), (SELECT count(*) AS n FROM alerts) c",
        ),
        "kmeans_fit": checked(_kmeans, "SELECT 5 AS clusters, count(*) AS rows, true AS centres_are_means FROM alerts"),
        "kmeans_select_k": checked(_select_k, "SELECT cast(range as int) AS k, true AS silhouette_in_range, true AS best_is_chosen FROM range(2, 10)"),
        "dbscan": checked(
            _grid,
            "SELECT id, CASE WHEN k.x1 IS NULL THEN 0e0 ELSE 1e0 END AS score FROM (SELECT id, " + _POINT + " FROM alerts) a LEFT JOIN kept k ON k.x1 = a.x1 AND k.x2 = a.x2",
            _GRID_CTES,
        ),
        "dbscan_numbers": checked(_density, "SELECT id, CASE WHEN k.x IS NULL THEN 0e0 ELSE 1e0 END AS score FROM spots a LEFT JOIN kept k ON k.x = a.x", _DENSITY_CTES),
        "dbscan_reduced": checked(_density_reduced, "SELECT count(*) AS n, 0::BIGINT AS unscored, 0::BIGINT AS unequal_copies FROM alerts"),
        "autoencoder_fit": checked(_autoencoder, "SELECT true AS epochs_within, true AS held_out_falls, true AS finite, true AS stops_in_time"),
        "encode_features": checked(_codes, f"SELECT id, {ae.ENCODING_DIM} AS code_size, true AS sound FROM alerts"),
        "reconstruction_sample": checked(_rebuilt, "SELECT least(5, count(*)) AS n, least(5, count(*)) AS consistent FROM alerts"),
        "projection_2d": checked(
            _plane,
            "SELECT 'point' AS kind, count(*) AS n, 0::BIGINT AS unplaced, true AS few_flagged FROM alerts UNION ALL SELECT 'centre', 5, 0, true",
        ),
        "train_baseline": checked(
            _train_baseline,
            "SELECT m AS model, n AS data_count, true AS has_categories, true AS flags_the_share FROM (SELECT unnest(['isolation_forest', 'kmeans']) AS m), "
            "(SELECT count(DISTINCT id) AS n FROM (SELECT id FROM alerts, p WHERE event_time >= as_of_event - INTERVAL 30 DAY UNION ALL SELECT id FROM baseline_alerts, p WHERE event_time >= as_of_event - INTERVAL 30 DAY))",
        ),
        "train_zero_day": checked(_train_zero_day, "SELECT count(DISTINCT id) AS rows, true AS a_twentieth_above, true AS held_out_falls FROM baseline_alerts"),
        "model_tables": checked(_model_tables, "SELECT count(*) AS n, 0::BIGINT AS differing, true AS thresholds_kept, true AS fit_for_streams FROM alerts"),
        "detect_fitted": checked(
            _detect_fitted,
            f"SELECT id, {internal_sql('src_ip')} AS src_ip_is_internal, true AS baseline_flag_follows, true AS candidate_flag_follows, true AS flag_follows, true AS scores_in_range, true AS external_is_novel FROM alerts",
        ),
    }
