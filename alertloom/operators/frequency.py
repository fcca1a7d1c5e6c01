"""Relative frequency of values, as a table and joined back to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.operators.joins import HOT_FRACTION, lookup
from alertloom.schemas import FREQUENCY_COLUMNS
from alertloom.storage import BROADCAST_ROWS, materialise


def value_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n, freq) for every non-null value of the columns.

    All columns are counted in one pass over the table; the counts are combined
    on the map side, so a frequent value costs one row per task.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = (
        df.select(pairs.alias("_pair"))
        .select("_pair.*")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per column: bounded by the number of columns asked for.
    totals = df.agg(*[F.count(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("total")) for c in columns]))
    totals = totals.select(rows.alias("_t")).select("_t.*")
    return counts.join(F.broadcast(totals), "column_name").select(
        "column_name", "value", "n", (F.col("n") / F.col("total")).alias("freq")
    )


def add_frequency_features(
    df: DataFrame, columns: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS, frozen: DataFrame | None = None
) -> DataFrame:
    """`<column>_freq` per row: share of the row's value among non-null values.

    The frequency table is written once; its size per column decides between a
    broadcast and the skew-safe shuffle lookup. A null value has frequency 0.
    `frozen` is a table of value_frequency to look values up in instead of this
    batch's own; values it lacks have frequency 0.
    """
    wanted = [c for c in (columns or FREQUENCY_COLUMNS) if c in df.columns]
    if not wanted:
        return df
    table = materialise(value_frequency(df, wanted)) if frozen is None else frozen
    sizes = {r["column_name"]: r["n"] for r in table.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for column in wanted:
        name = f"{column}_freq"
        part = table.where(F.col("column_name") == column).select(F.col("value").alias("_value"), F.col("freq").alias(name))
        # The table has the exact shares, so the hot values need no further scan.
        hot = part.where(F.col(name) > 1 / HOT_FRACTION).select("_value")
        out = lookup(out, part, column, "_value", small=sizes.get(column, 0) <= broadcast_rows, hot_keys=hot)
        out = out.withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out
