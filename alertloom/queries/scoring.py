"""Registered queries: scoring with fixed model parameters, checked value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions import scores
from alertloom.models import thresholds
from alertloom.models.scorer import ModelSet, add_raw_scores
from alertloom.operators import aggregates as agg
from alertloom.operators import filters, sinks, topk
from alertloom.plans import baseline, classify, detect, sweep
from alertloom.queries import literal
from alertloom.queries.features import internal_sql
from alertloom.queries.registry import Query, checked
from alertloom.queries.relational import ALL, DETAIL_SQL
from alertloom.schemas import ALERT_COLUMNS, BASELINE_MIN_SCORE, CATEGORICAL_COLUMNS, NUMERIC_COLUMNS, PORT_COLUMNS, STATE_SCHEMA, ZERO_DAY_SCHEMA
from alertloom.sources.scans import detection_window
from alertloom.sources.views import Views
from alertloom.storage import materialise, scratch_path

_PATHS = [[repr(literal.leaf_path(n[4], n[5])) for n in tree if n[0] < 0] for tree in literal.TREES]


def fixed_ctes(source: str) -> str:
    """Raw and normalised scores of the fixed models over `source`."""
    (t1a, t1b, t1c), (t2a, t2b, t2c) = _PATHS
    c256 = repr(literal.leaf_path(256, 0))
    return (
        f"fx AS (SELECT *, cast(bytes_to_server as double) / 1000 AS x1, cast(packets_to_server as double) / 100 AS x2, cast(threat_level as double) / 10 AS x3, "
        f"{internal_sql('src_ip')} AS src_internal FROM {source}), "
        f"h AS (SELECT *, CASE WHEN x1 < 5 THEN {t1a}e0 WHEN x2 < 2 THEN {t1b}e0 ELSE {t1c}e0 END AS h1, "
        f"CASE WHEN x3 >= 4 THEN {t2a}e0 WHEN x1 < 10 THEN {t2b}e0 ELSE {t2c}e0 END AS h2, "
        "sqrt(least((x1-1)*(x1-1)+(x2-1)*(x2-1), (x1-6)*(x1-6)+(x2-3)*(x2-3), (x1-12)*(x1-12)+(x2-4)*(x2-4))) AS km_raw, "
        "(x1-5)/4 AS z1, (x2-2)/2 AS z2, (x3-2.5e0)/1.1e0 AS z3 FROM fx), "
        "ab AS (SELECT *, greatest(0.0e0, 0.6e0*z1+0.4e0*z2) AS ca, greatest(0.0e0, 0.9e0*z3-0.1e0*z1) AS cb FROM h), "
        f"raw AS (SELECT *, -power(2.0e0, -(h1+h2)/2/{c256}e0) AS if_raw, "
        "((z1-0.8e0*ca)*(z1-0.8e0*ca) + (z2-(0.7e0*ca+0.1e0*cb))*(z2-(0.7e0*ca+0.1e0*cb)) + (z3-0.9e0*cb)*(z3-0.9e0*cb))/3 AS err FROM ab), "
        f"st AS (SELECT min(if_raw) AS if_lo, max(if_raw) AS if_hi, min(km_raw) AS km_lo, max(km_raw) AS km_hi, min(err) AS e_lo, max(err) AS e_hi, quantile_cont(err, 0.95) AS e95 FROM raw), "
        "sc AS (SELECT *, (if_raw-if_lo)/(if_hi-if_lo+1e-10) AS if_score, 1-(km_raw-km_lo)/(km_hi-km_lo+1e-10) AS km_score, (err-e_lo)/(e_hi-e_lo) AS recon FROM raw, st), "
        "fl AS (SELECT *, round(if_score,6) < 0.8 OR round(km_score,6) < 0.8 AS base, round(err,6) > round(e95,6) AS cand, 0.7e0*recon + 0.3e0*(if_score + (1-km_score))/2 AS s FROM sc), "
        "det AS (SELECT *, (base AND cand) OR src_internal = 0 AS zd, CASE WHEN src_internal = 0 THEN greatest(0.7e0, s) ELSE s END AS zs FROM fl), "
        "cls AS (SELECT *, round(if_score,6) < 0.5 AS if_a, round(km_score,6) < 0.5 AS km_a, round(if_score,6) < 0.5 OR round(km_score,6) < 0.5 AS anomaly, 0.6e0*if_score + 0.4e0*km_score AS a_score FROM sc)"
    )


FIXED = fixed_ctes("alerts")
# Candidates of the baseline update.
_UPDATE = (
    "cand_in AS (SELECT alerts.* FROM alerts, p WHERE created_at >= as_of - INTERVAL 30 DAY AND category NOT IN ('严重漏洞', '勒索软件', '数据泄露') "
    "AND id NOT IN (SELECT id FROM baseline_alerts)), "
)


def fixed_models() -> ModelSet:
    return literal.literal_models()


def _raw(v: Views, *keep: str) -> DataFrame:
    """Raw scores of the fixed models beside the asked columns."""
    models = fixed_models()
    return add_raw_scores(models.encode(v.alerts), models).select("id", *keep, "if_raw", "km_raw", "err")


def with_threshold(v: Views) -> ModelSet:
    """The fixed models with their error threshold learnt from the whole table."""
    return literal.literal_models(thresholds.recon_threshold(_errors(v)))


def _errors(v: Views) -> DataFrame:
    """Errors written once, for the passes of an exact quantile."""
    return materialise(_raw(v).select("id", "err"), "errors")


def _normalised(v: Views, *keep: str) -> DataFrame:
    raw = materialise(_raw(v, *keep), "raw")
    forest = scores.minmax_normalise(F.col("if_raw"), scores.batch_range(raw, "if_raw"))
    kmeans = scores.inverse_minmax(F.col("km_raw"), scores.batch_range(raw, "km_raw"))
    return raw.withColumns({"if_score": forest, "km_score": kmeans})


def _classified(v: Views) -> DataFrame:
    return classify.classify_alerts(v.alerts, fixed_models(), threshold=BASELINE_MIN_SCORE)


def _detected(v: Views) -> DataFrame:
    return detect.detect_zero_day(v.alerts, with_threshold(v))


# Rows of the last day, as the detection job takes them.
_DAY = "win AS (SELECT alerts.* FROM alerts, p WHERE event_time BETWEEN as_of_event - INTERVAL 24 HOUR AND as_of_event), " + fixed_ctes("win")


def _run_detection(v: Views) -> DataFrame:
    """The detection job, run twice: summary of the first run, and what is stored after both."""
    path, state = scratch_path(v.spark, "job-out"), scratch_path(v.spark, "job-state")
    window = detection_window(v.alerts, 24, v.as_of_event)
    errors = materialise(add_raw_scores(fixed_models().encode(window), fixed_models()).select("id", "err"), "errors")
    models = literal.literal_models(thresholds.recon_threshold(errors))
    summary, _ = detect.run_detection(v.alerts, models, path, state, v.as_of_event)
    summary = materialise(summary, "summary")
    detect.run_detection(v.alerts, models, path, state, v.as_of_event)
    stored = v.spark.read.schema(ZERO_DAY_SCHEMA).parquet(path).agg(F.count(F.lit(1))).scalar()
    log = v.spark.read.schema(STATE_SCHEMA).parquet(state)
    last = sinks.state_latest(log).where("config_key = 'last_zero_day_detection_update'").agg(F.max("config_value")).scalar()
    return summary.withColumns({"stored": stored, "last_update": last})


def _scored_for_sweep(v: Views) -> tuple[DataFrame, ModelSet]:
    models = with_threshold(v)
    return detect.score_raw_alerts(v.alerts, models), models


def _sweep(v: Views) -> DataFrame:
    return sweep.sensitivity_sweep(*_scored_for_sweep(v))


# Milder presets, so that some fall in the reasonable range on the test tables.
MILD = [
    sweep.Preset("mild-99", 99, 0.2, False, True),
    sweep.Preset("mild-97", 97, 0.1, False, True),
    sweep.Preset("mild-95", 95, 0.0, False, False),
    sweep.Preset("mild-90", 90, 0.0, False, False),
]


def _mild_sweep(v: Views) -> DataFrame:
    return sweep.sensitivity_sweep(*_scored_for_sweep(v), MILD)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


_CLASS_FLAGS = "isolation_forest_anomaly", "kmeans_anomaly", "is_anomaly"
_CLASS_SQL = (
    "round(if_score, 6) AS isolation_forest_score, round(km_score, 6) AS kmeans_score, if_a AS isolation_forest_anomaly, km_a AS kmeans_anomaly, anomaly AS is_anomaly, round(a_score, 6) AS anomaly_score"
)


def _percent(part: str, total: str) -> str:
    return f"round(100e0 * ({part}) / greatest({total}, 1), 2)"


def _totals_sql(flag: str, table: str) -> str:
    k = f"count(*) FILTER ({flag})"
    return (
        f"SELECT count(*) AS total, {k} AS flagged, count(*) - {k} AS normal, {_percent(k, 'count(*)')} AS flagged_pct, "
        f"{_percent(f'count(*) - {k}', 'count(*)')} AS normal_pct FROM {table}"
    )


def _models_queries() -> dict[str, Query]:
    grid = ", ".join(f"({t}e0)" for t in thresholds.GRID)
    confusion = (
        f"grid AS (SELECT t AS threshold, count(*) FILTER (g AND y) AS tp, count(*) FILTER (g AND NOT y) AS fp, count(*) FILTER (NOT g AND y) AS fn, count(*) FILTER (NOT g AND NOT y) AS tn "
        f"FROM (SELECT t, round(if_score, 6) < t AS g, threat_level = 40 AS y FROM sc, (VALUES {grid}) q(t)) GROUP BY t), "
        "met AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / cast(tp + fp as double) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / cast(tp + fn as double) ELSE 0 END AS recall, "
        "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / cast(2 * tp + fp + fn as double) ELSE 0 END AS f1 FROM grid)"
    )
    with_grid = f"{FIXED}, {confusion}"

    def labelled(v: Views) -> DataFrame:
        return _normalised(v, "threat_level").withColumn("label", F.col("threat_level") == 40)

    def contamination(v: Views) -> DataFrame:
        scored = materialise(_normalised(v).select("id", "if_score"), "scores")
        t = thresholds.threshold_by_contamination(scored, "if_score", 0.05)
        return scored.agg(
            F.round(F.lit(t), 6).alias("threshold"),
            F.count_if(F.col("if_score") < F.lit(t)).alias("anomalies"),
            F.round(F.count_if(F.col("if_score") < F.lit(t)) / F.count(F.lit(1)) * 100, 6).alias("anomaly_percent"),
        )

    def report(v: Views) -> DataFrame:
        out = thresholds.model_report(
            materialise(_normalised(v), "scores"), {"isolation_forest": "if_score", "kmeans": "km_score"}, {"isolation_forest": 0.05, "kmeans": 0.1}, 3
        )
        return out.withColumns({c: F.round(c, 6) for c in ("threshold", "anomaly_percent")})

    def kth(score: str, c: float) -> str:
        return f"(SELECT {score} FROM sc ORDER BY 1 LIMIT 1 OFFSET (SELECT cast(floor(count(*) * {c}e0) as bigint) FROM sc))"

    def report_sql(model: str, score: str, c: float) -> str:
        k = kth(score, c)
        return (
            f"SELECT '{model}' AS model, round({k}, 6) AS threshold, count(*) FILTER ({score} < {k}) AS anomaly_count, round(count(*) FILTER ({score} < {k}) / cast(count(*) as double) * 100, 6) AS anomaly_percent, "
            "3 AS feature_dim, count(*) AS data_count FROM sc"
        )

    return {
        "iforest_score": checked(
            lambda v: _normalised(v).select("id", *r6("if_raw", "if_score")),
            "SELECT id, round(if_raw, 6) AS if_raw, round(if_score, 6) AS if_score FROM sc",
            FIXED,
        ),
        "kmeans_score": checked(
            lambda v: _normalised(v).select("id", *r6("km_raw", "km_score")),
            "SELECT id, round(km_raw, 6) AS km_raw, round(km_score, 6) AS km_score FROM sc",
            FIXED,
        ),
        "recon_error": checked(lambda v: _raw(v).select("id", *r6("err")), "SELECT id, round(err, 6) AS err FROM raw", FIXED),
        "minmax_normalise": checked(
            lambda v: (lambda d: d.select("id", F.round(scores.minmax_normalise(F.col("x"), scores.batch_range(d, "x")), 6).alias("y")))(
                v.alerts.select("id", F.col("bytes_to_server").cast("double").alias("x"))
            ),
            "SELECT id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER () + 1e-10), 6) AS y FROM (SELECT id, cast(bytes_to_server as double) AS x FROM alerts)",
        ),
        "inverse_minmax": checked(
            lambda v: (lambda d: d.select("id", F.round(scores.inverse_minmax(F.col("x"), scores.batch_range(d, "x")), 6).alias("y")))(
                v.alerts.select("id", F.col("bytes_to_server").cast("double").alias("x"))
            ),
            "SELECT id, round(1 - (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER () + 1e-10), 6) AS y FROM (SELECT id, cast(bytes_to_server as double) AS x FROM alerts)",
        ),
        "recon_normalise": checked(
            lambda v: (lambda d: d.select("id", F.round(scores.recon_normalise(F.col("err"), scores.batch_range(d, "err"), F.lit(1.0)), 6).alias("recon")))(_raw(v)),
            "SELECT id, round(recon, 6) AS recon FROM sc",
            FIXED,
        ),
        "recon_threshold": checked(
            lambda v: v.spark.createDataFrame([(round(thresholds.recon_threshold(_errors(v)), 6),)], "threshold double"),
            "SELECT round(e95, 6) AS threshold FROM st",
            FIXED,
        ),
        "is_zero_day": checked(
            lambda v: (lambda e: thresholds.is_zero_day(e, thresholds.recon_threshold(e)).select("id", "is_zero_day"))(_errors(v)),
            "SELECT id, cand AS is_zero_day FROM fl",
            FIXED,
        ),
        "is_anomaly": checked(
            lambda v: thresholds.is_anomaly(_normalised(v), "if_score", 0.8).select("id", "is_anomaly"),
            "SELECT id, round(if_score, 6) < 0.8 AS is_anomaly FROM sc",
            FIXED,
        ),
        "anomaly_score": checked(
            lambda v: _normalised(v).select("id", F.round(scores.anomaly_score(F.col("if_score"), F.col("km_score")), 6).alias("anomaly_score")),
            "SELECT id, round(a_score, 6) AS anomaly_score FROM cls",
            FIXED,
        ),
        "threshold_grid": checked(
            lambda v: thresholds.threshold_grid(labelled(v), "if_score", "label"), "SELECT threshold, tp, fp, fn, tn FROM grid", with_grid
        ),
        "classification_metrics": checked(
            lambda v: thresholds.classification_metrics(thresholds.threshold_grid(labelled(v), "if_score", "label")).select("threshold", *r6("precision", "recall", "f1")),
            "SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM met",
            with_grid,
        ),
        "threshold_by_f1": checked(
            lambda v: thresholds.threshold_by_f1(labelled(v), "if_score", "label").select("threshold", *r6("precision", "recall", "f1")),
            "SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM met ORDER BY met.f1 DESC, threshold LIMIT 1",
            with_grid,
        ),
        "threshold_by_contamination": checked(
            contamination,
            f"SELECT round({kth('if_score', 0.05)}, 6) AS threshold, count(*) FILTER (if_score < {kth('if_score', 0.05)}) AS anomalies, "
            f"round(count(*) FILTER (if_score < {kth('if_score', 0.05)}) / cast(count(*) as double) * 100, 6) AS anomaly_percent FROM sc",
            FIXED,
        ),
        "model_report": checked(
            report, report_sql("isolation_forest", "if_score", 0.05) + " UNION ALL " + report_sql("kmeans", "km_score", 0.1), FIXED
        ),
    }


def _classify_queries() -> dict[str, Query]:
    filled = f"{FIXED}, clf AS (SELECT cls.* REPLACE (coalesce(category, 'unknown') AS category, coalesce(event_type, 'unknown') AS event_type) FROM cls)"
    update = _UPDATE + fixed_ctes("cand_in")
    stored = ", ".join(
        f"coalesce({c}, 'unknown') AS {c}"
        if c in CATEGORICAL_COLUMNS
        else f"coalesce({c}, 0) AS {c}"
        if c in NUMERIC_COLUMNS + PORT_COLUMNS
        else f"coalesce({c}, '') AS {c}"
        if c in ("device_name", "device_ip", "src_ip", "src_mac", "dst_ip", "dst_mac")
        else c
        for c in ALERT_COLUMNS
    )
    top = "SELECT {c} , count(*) AS n FROM {t} WHERE {f} AND {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 10"
    risk = (
        "SELECT category, count(*) FILTER (NOT anomaly) AS normal, count(*) FILTER (anomaly) AS anomalous, count(*) AS total, "
        "round(count(*) FILTER (anomaly) / cast(count(*) as double) * 100, 6) AS risk_pct FROM clf GROUP BY category ORDER BY risk_pct DESC, category LIMIT 10"
    )

    def report(v: Views) -> DataFrame:
        parts = classify.filter_report(_classified(v))
        return agg.union_all(
            [
                parts["totals"].select(F.lit("totals").alias("part"), F.lit("flagged").alias("name"), F.col("flagged").alias("n")),
                parts["risk_by_category"].select(F.lit("risk"), "category", "anomalous").toDF("part", "name", "n"),
                parts["top_sources"].select(F.lit("sources"), "src_ip", "n").toDF("part", "name", "n"),
                parts["low_risk"].select(F.lit("low_risk"), F.col("category"), F.col("id")).toDF("part", "name", "n"),
                parts["high_risk"].select(F.lit("high_risk"), F.col("category"), F.col("id")).toDF("part", "name", "n"),
            ]
        )

    return {
        "classify_alerts": checked(
            lambda v: _classified(v).select("id", *r6("isolation_forest_score", "kmeans_score", "anomaly_score"), *_CLASS_FLAGS),
            f"SELECT id, {_CLASS_SQL} FROM cls",
            FIXED,
        ),
        "split_normal_anomalous": checked(
            lambda v: (lambda parts: parts[0].select("id", F.lit("anomalous").alias("part")).unionByName(parts[1].select("id", F.lit("normal").alias("part"))))(
                filters.split_by_flag(_classified(v), "is_anomaly")
            ),
            "SELECT id, CASE WHEN anomaly THEN 'anomalous' ELSE 'normal' END AS part FROM cls",
            FIXED,
        ),
        "report_totals": checked(lambda v: agg.report_totals(_classified(v), "is_anomaly"), _totals_sql("anomaly", "cls"), FIXED),
        "risk_crosstab": checked(lambda v: agg.risk_crosstab(_classified(v)), risk, filled),
        "top_anomalous_ips": checked(
            lambda v: agg.top_flagged(_classified(v), "is_anomaly", "src_ip"), top.format(c="src_ip", t="cls", f="anomaly"), FIXED
        ),
        "top_anomalous_types": checked(
            lambda v: agg.top_flagged(_classified(v), "is_anomaly", "event_type"), top.format(c="event_type", t="clf", f="anomaly"), filled
        ),
        "top5_high_risk": checked(
            lambda v: topk.top_high_risk(_classified(v).withColumn("anomaly_score", F.round("anomaly_score", 6))).select("id", "category", "src_ip", "dst_ip", "anomaly_score"),
            "SELECT id, category, src_ip, dst_ip, round(a_score, 6) AS anomaly_score FROM clf WHERE anomaly ORDER BY anomaly_score, id LIMIT 5",
            filled,
        ),
        "low_risk_sample": checked(
            lambda v: topk.low_risk_sample(_classified(v)).select("id", "category", "src_ip", "dst_ip", *r6("anomaly_score")),
            "SELECT id, category, src_ip, dst_ip, round(a_score, 6) AS anomaly_score FROM clf WHERE NOT anomaly ORDER BY id LIMIT 5",
            filled,
        ),
        "filter_report": checked(
            report,
            "SELECT 'totals' AS part, 'flagged' AS name, count(*) FILTER (anomaly) AS n FROM clf "
            f"UNION ALL SELECT 'risk', category, anomalous FROM ({risk}) UNION ALL SELECT 'sources', src_ip, n FROM ({top.format(c='src_ip', t='cls', f='anomaly')}) "
            "UNION ALL SELECT 'low_risk', category, id FROM (SELECT * FROM clf WHERE NOT anomaly ORDER BY id LIMIT 5) "
            "UNION ALL SELECT 'high_risk', category, id FROM (SELECT * FROM clf WHERE anomaly ORDER BY a_score, id LIMIT 5)",
            filled,
        ),
        "update_baseline": checked(
            lambda v: baseline.baseline_additions(v.alerts, v.baseline, fixed_models(), v.as_of),
            f"SELECT {stored}, (SELECT as_of FROM p) AS added_to_baseline_at FROM cls WHERE NOT anomaly",
            update,
        ),
        "baseline_candidates": checked(
            lambda v: baseline.baseline_candidates(v.alerts, v.baseline, v.as_of), f"SELECT {ALL} FROM cand_in", _UPDATE.rstrip(", ")
        ),
    }


def _sweep_cte(presets: list[sweep.Preset]) -> str:
    metrics = []
    for i, preset in enumerate(presets):
        ext = "src_internal = 0" if preset.external_is_zero_day else "false"
        score = f"round(CASE WHEN {ext} THEN greatest(0.7e0, s) ELSE s END, 6)"
        base = "base" if preset.baseline_required else "true"
        flag = f"((round(err, 6) > (SELECT round(quantile_cont(err, {preset.percentile / 100}), 6) FROM raw) AND {base} AND {score} >= {preset.min_score}) OR {ext})"
        k = f"count(*) FILTER ({flag})"
        metrics.append(
            f"SELECT {i} AS preset_order, '{preset.name}' AS config_name, count(*) AS total_alerts, count(*) FILTER (base) AS anomaly_count, {k} AS zero_day_count, "
            f"{_percent('count(*) FILTER (base)', 'count(*)')} AS anomaly_rate, {_percent(k, 'count(*)')} AS zero_day_rate, {_percent(k, 'count(*) FILTER (base)')} AS zero_day_of_anomaly_rate, "
            f"round(coalesce(avg(CASE WHEN {flag} THEN {score} END), 0), 3) AS avg_zero_day_score FROM fl"
        )
    return f"swept AS ({' UNION ALL '.join(metrics)})"


def _detect_queries() -> dict[str, Query]:
    detected_columns = (
        "round(if_score, 6) AS isolation_forest_score, round(1 - km_score, 6) AS kmeans_distance, round(err, 6) AS reconstruction_error, round(recon, 6) AS reconstruction_score_normalized, "
        f"base AS is_baseline_anomaly, cand AS is_zero_day_candidate, src_internal AS src_ip_is_internal, {internal_sql('dst_ip')} AS dst_ip_is_internal, {internal_sql('device_ip')} AS device_ip_is_internal, zd AS is_zero_day, round(zs, 6) AS zero_day_score"
    )
    rounded = ["isolation_forest_score", "kmeans_distance", "reconstruction_error", "reconstruction_score_normalized", "zero_day_score"]
    top = "SELECT {c}, count(*) AS n FROM det WHERE zd AND {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 10"

    def r(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.round(c, 6) for c in rounded})

    def report(v: Views) -> DataFrame:
        parts = detect.zero_day_report(_detected(v))
        return agg.union_all(
            [
                parts["anomalies"].select(F.lit("anomalies").alias("part"), F.lit("flagged").alias("name"), F.col("flagged").alias("n")),
                parts["zero_days"].select(F.lit("zero_days"), F.lit("flagged"), "flagged").toDF("part", "name", "n"),
                parts["by_category"].select(F.lit("by_category"), "category", "n").toDF("part", "name", "n"),
                parts["top_sources"].select(F.lit("top_sources"), "src_ip", "n").toDF("part", "name", "n"),
                parts["top_scores"].select(F.lit("top_scores"), "src_ip", "id").toDF("part", "name", "n"),
            ]
        )

    swept = f"{FIXED}, {_sweep_cte(sweep.PRESETS)}"
    mild = f"{FIXED}, {_sweep_cte(MILD)}"

    return {
        "detect_zero_day": checked(lambda v: r(_detected(v)), f"SELECT {ALL}, {detected_columns} FROM det", FIXED),
        "zero_day_score": checked(
            lambda v: r(_detected(v)).select("id", "is_zero_day", "zero_day_score"), "SELECT id, zd AS is_zero_day, round(zs, 6) AS zero_day_score FROM det", FIXED
        ),
        "select_zero_day": checked(
            lambda v: r(filters.select_zero_day(_detected(v), v.as_of)).select("id", "zero_day_score", "detected_at"),
            "SELECT id, round(zs, 6) AS zero_day_score, (SELECT as_of FROM p) AS detected_at FROM det WHERE zd",
            FIXED,
        ),
        "top5_zero_day": checked(
            lambda v: topk.top_zero_days(r(_detected(v))).select("id", "category", "src_ip", "dst_ip", "zero_day_score"),
            "SELECT id, category, src_ip, dst_ip, round(zs, 6) AS zero_day_score FROM det WHERE zd ORDER BY zero_day_score DESC, id LIMIT 5",
            FIXED,
        ),
        "zero_day_report": checked(
            report,
            "SELECT 'anomalies' AS part, 'flagged' AS name, count(*) FILTER (base) AS n FROM det UNION ALL SELECT 'zero_days', 'flagged', count(*) FILTER (zd) FROM det "
            f"UNION ALL SELECT 'by_category', category, n FROM ({top.format(c='category')}) UNION ALL SELECT 'top_sources', src_ip, n FROM ({top.format(c='src_ip')}) "
            "UNION ALL SELECT 'top_scores', src_ip, id FROM (SELECT * FROM det WHERE zd ORDER BY zs DESC, id LIMIT 5)",
            FIXED,
        ),
        "save_zero_day": checked(
            lambda v: v.zero_day.unionByName(
                sinks.new_rows(v.zero_day, sinks.zero_day_rows(_detected(v).where("is_zero_day"))).withColumn("zero_day_score", F.round("zero_day_score", 6))
            ),
            f"SELECT {ALL}, zero_day_score FROM zero_day_alerts UNION ALL SELECT {ALL}, round(zs, 6) FROM det WHERE zd AND id NOT IN (SELECT id FROM zero_day_alerts)",
            FIXED,
        ),
        "detection_summary": checked(
            lambda v: detect.detection_summary(_detected(v), v.zero_day),
            "SELECT count(*) AS total_alerts, count(*) FILTER (base) AS anomaly_count, count(*) FILTER (zd) AS zero_day_count, count(*) FILTER (zd AND id NOT IN (SELECT id FROM zero_day_alerts)) AS saved_count FROM det",
            FIXED,
        ),
        "run_detection": checked(
            _run_detection,
            "SELECT count(*) AS total_alerts, count(*) FILTER (base) AS anomaly_count, count(*) FILTER (zd) AS zero_day_count, count(*) FILTER (zd) AS saved_count, "
            "count(*) FILTER (zd) AS stored, (SELECT strftime(as_of_event, '%Y-%m-%d %H:%M:%S') FROM p) AS last_update FROM det",
            _DAY,
        ),
        "detection_details": checked(
            lambda v: detect.detection_details(r(_detected(v))),
            f"SELECT {DETAIL_SQL} FROM (SELECT *, round(zs, 6) AS zero_day_score FROM det WHERE zd)",
            FIXED,
        ),
        "preset_grid": checked(
            lambda v: _sweep(v).select("config_name", "total_alerts", "zero_day_count"), "SELECT config_name, total_alerts, zero_day_count FROM swept", swept
        ),
        "sensitivity_sweep": checked(_sweep, "SELECT * FROM swept", swept),
        "preset_baselines": checked(
            lambda v: sweep.preset_baselines(materialise(_raw(v).select("if_raw", "km_raw"), "raw"), fixed_models()),
            "SELECT o AS preset_order, n AS config_name, t AS threshold_score, count(*) AS total_alerts, count(*) FILTER (WHERE NOT (round(if_score, 6) < t OR round(km_score, 6) < t)) AS normal_count "
            f"FROM sc, (VALUES {', '.join(f"({i}, '{p.name}', {p.threshold_score}e0)" for i, p in enumerate(sweep.PRESETS))}) AS x(o, n, t) GROUP BY o, n, t",
            FIXED,
        ),
        "sweep_metrics": checked(
            lambda v: _sweep(v).select("config_name", "anomaly_rate", "zero_day_rate", "zero_day_of_anomaly_rate", "avg_zero_day_score"),
            "SELECT config_name, anomaly_rate, zero_day_rate, zero_day_of_anomaly_rate, avg_zero_day_score FROM swept",
            swept,
        ),
        "reasonable_configs": checked(
            lambda v: sweep.reasonable_configs(_mild_sweep(v)), "SELECT * FROM swept WHERE zero_day_rate BETWEEN 1 AND 5", mild
        ),
        "best_config": checked(
            lambda v: sweep.best_config(_mild_sweep(v)),
            "SELECT config_name, zero_day_rate, zero_day_of_anomaly_rate FROM swept WHERE zero_day_rate BETWEEN 1 AND 5 ORDER BY zero_day_of_anomaly_rate DESC, preset_order LIMIT 1",
            mild,
        ),
    }


def queries() -> dict[str, Query]:
    return {**_models_queries(), **_classify_queries(), **_detect_queries()}

