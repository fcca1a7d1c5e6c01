"""Deep pages of the history by rank.

The order is newest first (created_at, then id). How many rows stand before a page is
known from counts per stretch of the order: days, minutes, seconds, moments and, for very
many rows of one moment, ranges of the id. The counts of days and minutes can be stored
once as an index. A page then reads only the stretches that it meets, and sorts only
those rows; no task gathers the rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.filters import created_date_range

# Stretches are cut finer until the ones that a page meets hold at most so many rows.
STRETCH_ROWS = 20_000
ID_RANGES = 4_096
# Date of created_at, by which a stored history may be partitioned.
DATE_COLUMN = "created_date"

INDEX_COLUMNS = ["day", "minute", "n"]


def rank_index(rows: DataFrame) -> DataFrame:
    """day, minute, n: rows per minute of created_at. A null time has null day and minute."""
    minute = F.date_trunc("minute", "created_at").cast(rows.schema["created_at"].dataType)
    return rows.select(minute.alias("minute")).groupBy("minute").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("minute").alias("day"), "minute", "n")


def write_history(rows: DataFrame, path: str, index_path: str) -> None:
    """Stores a history by the date of created_at, with its index."""
    dated = rows.withColumn(DATE_COLUMN, F.to_date("created_at"))
    dated.hint("rebalance", DATE_COLUMN).write.mode("overwrite").partitionBy(DATE_COLUMN).parquet(path)
    rank_index(rows).write.mode("overwrite").parquet(index_path)


def _met(counts: DataFrame, order: Column, skip: int, size: int) -> tuple[list, int, int]:
    """Keys of the stretches that rows skip .. skip + size meet, rows before them, rows in them.

    counts: key, n; a stretch of the level above bounds how many keys there are.
    """
    before = F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before).where((F.col("before") < skip + size) & (F.col("before") + F.col("n") > skip))
    rows = placed.orderBy("before").limit(size + 1).collect()
    return [r["key"] for r in rows], rows[0]["before"] if rows else 0, sum(r["n"] for r in rows)


def _within(column: Column, keys: list) -> Column:
    known = [k for k in keys if k is not None]
    one = column.isNull() if None in keys else F.lit(False)
    # Stretches follow each other, so the rows between the first and the last are theirs.
    return one | column.between(F.lit(min(known)), F.lit(max(known))) if known else one


def deep_page(rows: DataFrame, skip: int, size: int, index: DataFrame | None = None, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Rows skip .. skip + size of the order; index: rank_index of just these rows."""
    kind = rows.schema["created_at"].dataType
    index = rank_index(rows) if index is None else index
    days, before, n = _met(index.groupBy(F.col("day").alias("key")).agg(F.sum("n").alias("n")), F.desc_nulls_last("key"), skip, size)
    if not days:
        return rows.limit(0)
    skip -= before
    known = [d for d in days if d is not None]
    if DATE_COLUMN in rows.columns:
        # Named days, so that a stored history opens only their folders.
        rows = rows.where((F.col(DATE_COLUMN).isNull() if None in days else F.lit(False)) | F.col(DATE_COLUMN).isin(known))
    if known:
        inside = (F.col("created_at") >= F.lit(min(known)).cast(kind)) & (F.col("created_at") < F.date_add(F.lit(max(known)), 1).cast(kind))
        rows = rows.where(inside | F.col("created_at").isNull() if None in days else inside)
    else:
        rows = rows.where(F.col("created_at").isNull())
    steps = [(lambda unit: F.date_trunc(unit, "created_at").cast(kind))(u) for u in ("minute", "second")] + [F.col("created_at")]
    for level, stretch in enumerate(steps):
        if n <= stretch_rows:
            break
        counts = index.where(_within(F.col("day"), days)).select(F.col("minute").alias("key"), "n") if level == 0 else rows.groupBy(stretch.alias("key")).agg(F.count(F.lit(1)).alias("n"))
        keys, before, n = _met(counts, F.desc_nulls_last("key"), skip, size)
        skip -= before
        rows = rows.where(_within(stretch, keys))
    else:
        if n > stretch_rows:
            rows, skip = _by_id(rows, skip, size)
    ordered = rows.orderBy(F.desc("created_at"), F.col("id"))
    return (ordered.offset(skip) if skip else ordered).limit(size)


def _by_id(rows: DataFrame, skip: int, size: int) -> tuple[DataFrame, int]:
    """Of rows whose first moment is met by the page, the ids of that moment up to the page are cut away."""
    first = rows.agg(F.max("created_at").alias("t")).first()["t"]
    top = F.col("created_at").eqNullSafe(F.lit(first))
    ends = rows.where(top).agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    width = max(1, -(-(ends["high"] - ends["low"] + 1) // ID_RANGES)) if ends["low"] is not None else 1
    stretch = F.floor((F.col("id") - F.lit(ends["low"])) / F.lit(width))
    keys, before, _ = _met(rows.where(top).groupBy(stretch.alias("key")).agg(F.count(F.lit(1)).alias("n")), F.asc_nulls_first("key"), skip, size)
    if not keys:  # the page begins after that moment
        return rows, skip
    low = next((k for k in keys if k is not None), None)
    kept = rows.where(~top | (stretch >= F.lit(low)) if None not in keys and low is not None else F.lit(True))
    return kept, skip - (before if None not in keys and low is not None else 0)


def history_deep_page(
    zero_day: DataFrame, start: str | None = None, end: str | None = None, page: int = 1, page_size: int = 10, index: DataFrame | None = None, stretch_rows: int = STRETCH_ROWS
) -> DataFrame:
    """One page of novel attacks, newest first, at any depth. index: of all of zero_day."""
    rows = created_date_range(zero_day, start, end)
    if index is not None and (start or end):
        # The bounds are whole days, so they cut the index at minutes.
        index = created_date_range(index.withColumn("created_at", F.col("minute")), start, end).select(*INDEX_COLUMNS)
    return deep_page(rows, (page - 1) * page_size, page_size, index, stretch_rows)
