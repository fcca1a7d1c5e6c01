"""Structured Streaming jobs: continuous detection, baseline upkeep, counts.

The polling jobs of a database-backed deployment re-read a day of alerts every
two hours. Here each alert is read once; progress, late rows and duplicates are
handled by the checkpoint, the watermark and the insert-if-absent sinks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from alertloom.models.scorer import ModelSet
from alertloom.operators.sinks import log_state
from alertloom.plans.baseline import update_baseline
from alertloom.plans.detect import detect_zero_day, save_zero_day
from alertloom.storage import materialise

# Longest delay between event and creation that is still counted, unless a job
# names another. Rows later than that are left out and counted by run_available.
LATENESS = "2 days"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A parquet table as a stream, be it a folder of files or a single file."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isDirectory():
        return file_stream(spark, path, schema, files_per_batch=files_per_batch)
    folder, _, name = path.rpartition("/")
    return file_stream(spark, folder, schema, name, files_per_batch)


def event_timed(stream: DataFrame, column: str = "event_time", lateness: str = LATENESS) -> DataFrame:
    """The stream with a watermark; zone-less times are read in the session zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def dedupe(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One row per id among rows that arrive within the watermark delay."""
    return event_timed(stream, lateness=lateness).dropDuplicatesWithinWatermark(["id"])


def daily_counts(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Alerts per day of event time."""
    day = F.window("event_time", "1 day")
    return event_timed(stream, lateness=lateness).groupBy(day).agg(F.count(F.lit(1)).alias("n")).select(
        F.to_date("window.start").alias("date"), "n"
    )


def sliding_counts(stream: DataFrame, length: str = "24 hours", step: str = "2 hours", lateness: str = LATENESS) -> DataFrame:
    """Alerts per sliding window of event time."""
    span = F.window("event_time", length, step)
    return event_timed(stream, lateness=lateness).groupBy(span).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        "n",
    )


# Progress reports kept of a run; the late rows are summed over them.
_REPORTS = "spark.sql.streaming.numRecentProgressUpdates"
KEPT_REPORTS = 1_000_000


def run_available(writer: DataStreamWriter, checkpoint: str) -> int:
    """Processes what is there now, then stops; a scheduler calls it again.

    Returns the rows that came too late for the watermark and were left out, over all
    micro-batches of the run.
    """
    spark = SparkSession.active()
    kept = spark.conf.get(_REPORTS, None)
    spark.conf.set(_REPORTS, str(KEPT_REPORTS))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
    finally:
        query.stop()
        spark.conf.unset(_REPORTS) if kept is None else spark.conf.set(_REPORTS, kept)


def append_files(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Stream rows into a parquet folder, each exactly once; returns the late rows."""
    return run_available(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def follow_counts(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Adds the windows that changed in each batch to `path`; returns the late rows.

    State of windows behind the watermark is dropped. A batch has its own partition,
    which a replay overwrites, so readers never meet a missing table.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run_available(stream.writeStream.outputMode("update").foreachBatch(store), checkpoint)


def current_counts(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The latest row of every window that follow_counts has written."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema.fieldNames() if c not in keys]), "batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*schema.fieldNames())


def follow_windows(stream: DataFrame, path: str, checkpoint: str, length: str = "1 day", step: str | None = None, lateness: str = LATENESS) -> None:
    """Counts alerts per window of event time and keeps those that come too late, in one table.

    A micro-batch adds its own counts per window and, as rows of their own, the alerts of
    windows that had closed before it: those that end at or before the watermark, which is
    the latest event time of the earlier batches less `lateness`. The watermark is stored
    with each batch, so a restarted job goes on from it, and a replayed batch overwrites
    its own partition. Nothing is dropped: counts and late rows together are the batch
    result (counted_windows, late_rows).
    """
    spark = SparkSession.active()
    last: dict[int, object] = {}

    def seen_before(number: int) -> object:
        if number - 1 in last or not number:
            return last.get(number - 1)
        stored = spark.read.schema(_WINDOW_MARKS).parquet(path).where((F.col("kind") == "mark") & (F.col("batch") < number))
        return stored.agg(F.max("latest").alias("t")).first()["t"]

    def store(batch: DataFrame, number: int) -> None:
        timed = batch.withColumn("event_time", F.col("event_time").cast("timestamp"))
        latest = seen_before(number)
        alert = F.struct(*batch.columns)
        spread = timed.select(F.window("event_time", length, step).alias("w"), alert.alias("alert"))
        closed = F.lit(False) if latest is None else F.col("w.end") <= F.lit(latest) - F.expr(f"INTERVAL {lateness}")
        none = lambda name, kind: F.lit(None).cast(kind).alias(name)
        kind = batch.schema.simpleString()
        span = [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]
        counts = spread.where(~closed).groupBy("w").agg(F.count(F.lit(1)).alias("n")).select(F.lit("count").alias("kind"), *span, "n", none("latest", "timestamp"), none("alert", kind))
        late = spread.where(closed).select(F.lit("late").alias("kind"), *span, none("n", "long"), none("latest", "timestamp"), "alert")
        mark = timed.agg(F.greatest(F.max("event_time"), F.lit(latest).cast("timestamp")).alias("latest"))
        mark = mark.select(F.lit("mark").alias("kind"), none("window_start", "timestamp"), none("window_end", "timestamp"), none("n", "long"), "latest", none("alert", kind))
        counts.union(late).union(mark).write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.clear()
        last[number] = spark.read.schema(_WINDOW_MARKS).parquet(f"{path}/batch={number}").where("kind = 'mark'").select("latest").first()["latest"]

    run_available(stream.writeStream.foreachBatch(store), checkpoint)


_WINDOW_MARKS = "kind string, latest timestamp, batch long"


def counted_windows(spark: SparkSession, path: str) -> DataFrame:
    """window_start, window_end, n of what came in time, over all batches that follow_windows has stored."""
    rows = spark.read.schema("kind string, window_start timestamp, window_end timestamp, n long, batch long").parquet(path)
    return rows.where("kind = 'count'").groupBy("window_start", "window_end").agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The alerts that came after their window had closed, with that window and the batch."""
    fields = [T.StructField("kind", T.StringType()), T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()), T.StructField("alert", schema), T.StructField("batch", T.LongType())]
    return spark.read.schema(T.StructType(fields)).parquet(path).where("kind = 'late'").select("window_start", "window_end", "batch", "alert.*")


def each_batch(stream: DataFrame, work: Callable[[DataFrame], None], checkpoint: str) -> None:
    def handle(batch: DataFrame, _: int) -> None:
        # Written once: the work has several actions, each of which would read the source again.
        rows = materialise(batch, "micro-batch")
        if not rows.isEmpty():
            work(rows)

    run_available(stream.writeStream.foreachBatch(handle), checkpoint)


def _need_frozen(models: ModelSet) -> None:
    if not models.frozen:
        raise ValueError("streaming needs models with frozen score ranges and frequencies")


def stream_detect(stream: DataFrame, models: ModelSet, path: str, checkpoint: str, internal: DataFrame | None = None) -> None:
    """Scores alerts as they arrive and saves new novel attacks once.

    The models must carry frozen score ranges and, if they use them, frozen
    frequencies: those of a micro-batch would depend on how the stream is cut.
    """
    _need_frozen(models)
    each_batch(stream, lambda batch: save_zero_day(detect_zero_day(batch, models, internal), path) and None, checkpoint)


def stream_baseline_update(
    stream: DataFrame, models: ModelSet, path: str, state_path: str, checkpoint: str, as_of: str, **options: object
) -> None:
    """Adds normal alerts to the baseline as they arrive and logs the update."""
    _need_frozen(models)

    def work(batch: DataFrame) -> None:
        added = update_baseline(batch, path, models, as_of, **options).first()["inserted"]
        if added:
            log_state(batch.sparkSession, state_path, "last_baseline_data_update", as_of)

    each_batch(stream, work, checkpoint)
