"""Writes: storage projection, insert-if-absent, state log, CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from alertloom.schemas import ALERT_SCHEMA, STATE_SCHEMA
from alertloom.storage import materialise


def project_storage_columns(df: DataFrame, text_nulls_to_empty: bool = True) -> DataFrame:
    """The stored columns present in df, in table order and in the table's types."""
    out = []
    for field in ALERT_SCHEMA.fields:
        if field.name not in df.columns:
            continue
        column = F.col(field.name)
        if isinstance(df.schema[field.name].dataType, T.BooleanType):
            column = column.cast("int")
        if not isinstance(field.dataType, T.TimestampNTZType):
            column = column.cast(field.dataType)
        if text_nulls_to_empty and isinstance(field.dataType, T.StringType):
            column = F.coalesce(column, F.lit(""))
        out.append(column.alias(field.name))
    return df.select(*out)


def one_per_id(df: DataFrame) -> DataFrame:
    """One row per id. The rank filter becomes a per-task group limit below the
    shuffle, so an id with very many copies is cut to one row per task first."""
    order = Window.partitionBy("id").orderBy(*df.columns)
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def new_rows(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates to insert: one per id, ids already stored left out."""
    return one_per_id(candidates).join(existing.select("id"), "id", "left_anti").select(*candidates.columns)


def insert_counts(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """How many candidate rows an insert adds and how many it skips."""
    inserted = new_rows(existing, candidates).agg(F.count(F.lit(1))).scalar()
    return candidates.agg(F.count(F.lit(1)).alias("sent")).select(
        "sent", inserted.alias("inserted"), (F.col("sent") - inserted).alias("skipped")
    )


def with_zero_day_score(df: DataFrame) -> DataFrame:
    """Adds zero_day_score 0.0 where the column is missing."""
    return df if "zero_day_score" in df.columns else df.withColumn("zero_day_score", F.lit(0.0))


def baseline_rows(normal: DataFrame, added_at: str) -> DataFrame:
    """Normal alerts in the layout of the baseline table."""
    stamp = F.lit(added_at).cast("timestamp_ntz")
    return project_storage_columns(normal).withColumn("added_to_baseline_at", stamp)


def zero_day_rows(detected: DataFrame) -> DataFrame:
    """Detected novel attacks in the layout of the zero-day table."""
    rows = with_zero_day_score(detected)
    stored = project_storage_columns(rows, text_nulls_to_empty=False)
    return rows.select(*stored.columns, F.col("zero_day_score").cast("double"))


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at `path`, or an empty frame of its schema before the first write."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def _stored_ids(spark: SparkSession, path: str, days: DataFrame, schema: T.StructType) -> DataFrame:
    """Ids in the day partitions that `days` (event_date) names."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], "id long")
    dated = spark.read.schema(T.StructType([schema["id"], T.StructField("event_date", T.DateType())])).parquet(path)
    # A batch has few days; the join prunes the partitions of all others.
    return dated.join(days, dated["event_date"].eqNullSafe(days["event_date"]), "left_semi").select("id")


def append_new(path: str, candidates: DataFrame, schema: T.StructType) -> DataFrame:
    """Appends the candidates whose id is not stored yet; returns the counts.

    Running it again with the same rows adds nothing, so a job may be repeated
    after a failure. One writer per table is assumed. The table is partitioned by
    the day of event_time; an alert keeps its event time, so its id can only be
    stored under its own day and the other days are not read.
    """
    spark = candidates.sparkSession
    existing = _stored_ids(spark, path, candidates.select(F.to_date("event_time").alias("event_date")).distinct(), schema)
    rows = new_rows(existing, candidates)
    stored = [F.col(f.name) if f.name in rows.columns else F.lit(None) for f in schema.fields]
    rows = rows.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(stored, schema.fields, strict=True)])
    # Decided once and written down, and counted as they are written.
    seen = Observation()
    rows = materialise(rows.observe(seen, F.count(F.lit(1)).alias("n")), "insert")
    inserted = seen.get["n"]
    if inserted:
        write_by_day(rows, path)
    return spark.createDataFrame([(inserted,)], "inserted long")


def write_by_day(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by the date of event_time, so that windows skip whole days.

    Rows of a day are brought together first, which keeps the files few; AQE
    splits the days that are too large for one file.
    """
    dated = df.withColumn("event_date", F.to_date("event_time"))
    dated.hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def csv_report(df: DataFrame, path: str) -> None:
    """Whole result as CSV part files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def log_state(spark: SparkSession, path: str, key: str, moment: str) -> None:
    """One entry in the append-only state log."""
    row = spark.createDataFrame([(key, moment[:19])], "config_key string, config_value string")
    row.withColumn("last_updated", F.lit(moment).cast("timestamp_ntz")).select(*STATE_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def state_latest(log: DataFrame) -> DataFrame:
    """Current value per key of an append-only state log."""
    order = F.struct("last_updated", "entry_id") if "entry_id" in log.columns else F.col("last_updated")
    return log.groupBy("config_key").agg(
        F.max_by("config_value", order).alias("config_value"), F.max("last_updated").alias("last_updated")
    )


def state_get(log: DataFrame, keys: list[str], default: str | None = None) -> DataFrame:
    """Value of each asked key, `default` where the key has none."""
    asked = log.sparkSession.createDataFrame([(k,) for k in keys], "config_key string")
    found = state_latest(log.where(F.col("config_key").isin(keys)))
    joined = asked.join(F.broadcast(found), "config_key", "left")
    return joined.select("config_key", F.coalesce("config_value", F.lit(default)).alias("config_value"))


def state_upsert(log: DataFrame, updates: DataFrame) -> DataFrame:
    """State after the updates: append to the log, keep the latest entry per key."""
    return state_latest(log.unionByName(updates, allowMissingColumns=True))


def last_update_times(log: DataFrame, components: list[str]) -> DataFrame:
    """Last update per component; unreadable text becomes null."""
    values = state_get(log, [f"last_{c}_update" for c in components])
    parsed = F.try_to_timestamp("config_value", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return values.select(
        F.regexp_extract("config_key", "^last_(.*)_update$", 1).alias("component"),
        parsed.alias("last_update"),
        F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("last_update_text"),
    )
