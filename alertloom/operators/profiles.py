"""Profiles over long histories from sketches that are stored per day.

A day is read once: its rows, nulls, least and greatest values exactly, its distinct
values and quantiles as mergeable sketches. A profile of any run of whole days merges
the days' sketches and reads no alert. Exact quantiles take from the merged sketch a
narrow range that each must lie in, and from the stored counts the number of rows; what
is left is one counting pass and a search among the few rows inside those ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.operators.aggregates import PROFILE_COLUMNS
from alertloom.operators.quantiles import exact_quantiles, quantiles_within

KLL_K = 4_000  # ranks of the quantile sketches are off by less than RANK_ERROR
RANK_ERROR = 0.002


def daily_sketches(df: DataFrame, time: str = "event_time", texts: list[str] | None = None, numbers: list[str] | None = None) -> DataFrame:
    """A row per day of `time`: rows, and per column its nulls, sketch and, for numbers, range.

    Combined on the map side; a sketch has a bounded size whatever the day holds. Rows
    without a time have a day of their own, null.
    """
    texts = [c for c in (PROFILE_COLUMNS if texts is None else texts) if c in df.columns]
    out = [F.count(F.lit(1)).alias("rows")]
    for c in texts:
        out += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"), F.hll_sketch_agg(F.col(c).cast("string"), 14).alias(f"hll_{c}")]
    for c in numbers or []:
        x = F.col(c).cast("double")
        sound = F.abs(x) < float("inf")
        out += [F.count(x).alias(f"n_{c}"), F.count_if(~sound).alias(f"odd_{c}"), F.min(F.when(sound, x)).alias(f"min_{c}"), F.max(F.when(sound, x)).alias(f"max_{c}")]
        out.append(F.kll_sketch_agg_double(F.when(sound, x), KLL_K).alias(f"kll_{c}"))
    return df.groupBy(F.to_date(time).alias("day")).agg(*out)


def _days(sketches: DataFrame, first: str, last: str) -> DataFrame:
    return sketches.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def window_profile(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """rows, and about how many distinct values each text column has in the days first .. last;
    a missing value counts as one. From the sketches alone."""
    names = [c.removeprefix("hll_") for c in sketches.columns if c.startswith("hll_")]
    merged = _days(sketches, first, last).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.hll_union_agg(f"hll_{c}").alias(f"hll_{c}") for c in names], *[F.sum(f"nulls_{c}").alias(f"nulls_{c}") for c in names])
    distinct = lambda c: F.coalesce(F.hll_sketch_estimate(f"hll_{c}"), F.lit(0)) + F.coalesce((F.col(f"nulls_{c}") > 0).cast("long"), F.lit(0))
    return merged.select("rows", *[distinct(c).alias(c) for c in names])


def window_quantiles(df: DataFrame, sketches: DataFrame, column: str, fractions: list[float], first: str, last: str, time: str = "event_time") -> dict[float, float | None]:
    """Exact quantiles, with linear interpolation, of a number over the days first .. last.

    sketches: daily_sketches of df. A window that holds NaN or an infinity is searched
    without them.
    """
    rows = df.where((F.col(time) >= F.lit(first).cast("date")) & (F.col(time) < F.date_add(F.lit(last).cast("date"), 1)))
    marks = sorted({min(1.0, max(0.0, f + d)) for f in fractions for d in (-RANK_ERROR, RANK_ERROR)})
    merged = _days(sketches, first, last).agg(F.sum(f"n_{column}").alias("n"), F.sum(f"odd_{column}").alias("odd"), F.kll_merge_agg_double(f"kll_{column}").alias("kll"))
    known = merged.select("n", "odd", *[F.when(F.col("n") > F.col("odd"), F.kll_sketch_get_quantile_double("kll", F.lit(m))).alias(f"m{k}") for k, m in enumerate(marks)]).first()
    if not known["n"]:
        return dict.fromkeys(fractions)
    if known["odd"]:
        return exact_quantiles(rows, column, fractions)
    return quantiles_within(rows, column, fractions, known["n"], sorted({known[f"m{k}"] for k in range(len(marks))}))


def window_error_quantiles(df: DataFrame, sketches: DataFrame, column: str, first: str, last: str, time: str = "event_time") -> DataFrame:
    """min, quartiles, 95th percentile and max of a number over whole days in one row; the
    least and greatest come from the stored days."""
    names = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    values = window_quantiles(df, sketches, column, list(names.values()), first, last, time)
    ends = _days(sketches, first, last).agg(F.min(f"min_{column}").alias("min_value"), F.max(f"max_{column}").alias("max_value"))
    return ends.withColumns({n: F.lit(None if values[f] is None or math.isnan(values[f]) else values[f]).cast("double") for n, f in names.items()})
