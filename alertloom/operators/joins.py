"""Lookups and set comparisons by key, safe against hot keys.

Joins on the alert id keep all rows of the left side, copies included; their
oversized partitions are split by AQE's skew handling, which covers the left
side of anti, semi and left joins. Lookups by attribute need more:

A lookup side is broadcast only after a check of its size. Beyond that size the
join is split: the few keys that hold a large share of the rows (at most
HOT_FRACTION of them by construction) are looked up through a broadcast of just
those keys, and all other rows take the shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.storage import BROADCAST_ROWS, fits

# A key with more than 1/HOT_FRACTION of all rows is hot; so there are fewer
# than HOT_FRACTION hot keys, whatever the data.
HOT_FRACTION = 1000
_TRACKED_KEYS = 10_000
_LEAST_SPREAD = 1024


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str,
    broadcast_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
    hot_keys: DataFrame | None = None,
) -> DataFrame:
    """Left join of `fact` to `dim`, whose key is unique; adds dim's other columns.

    `small` skips the size check where the caller has already made it; `hot_keys`
    (one column, fewer than HOT_FRACTION rows) the search for hot keys.
    """
    values = [c for c in dim.columns if c != dim_key]
    if small is None:
        small = fits(dim.select(dim_key), broadcast_rows)
    if small:
        side = F.broadcast(dim.withColumnRenamed(dim_key, "_key"))
        return fact.join(side, fact[fact_key] == side["_key"], "left").drop("_key")
    if hot_keys is None:
        hot = _hot_hashes(fact, fact_key)
    else:
        hot = [r[0] for r in hot_keys.select(F.xxhash64(hot_keys.columns[0])).limit(HOT_FRACTION).collect()]
    return _split_lookup(fact, dim, fact_key, dim_key, values, hot)


def _hot_hashes(fact: DataFrame, key: str) -> list[int]:
    """Hashes of the keys holding more than 1/HOT_FRACTION of the rows.

    One mergeable sketch per task, no shuffle of keys. The sketch may name a key
    too many or too few; that only moves rows between two exact join paths.
    """
    known = fact.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    top = F.expr(f"approx_top_k(h, {HOT_FRACTION}, {_TRACKED_KEYS})")
    row = known.agg(F.count(F.lit(1)).alias("total"), top.alias("top")).first()
    return [item["item"] for item in row["top"] or [] if item["count"] * HOT_FRACTION > row["total"]]


def _split_lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, values: list[str], hot: list[int]) -> DataFrame:
    # As many salts as a shuffle has partitions, so their share of the rows does
    # not grow with the cluster's work.
    salts = max(_LEAST_SPREAD, int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Hot and null keys are settled here: they get a null key below and are
    # spread over the partitions by a hash of the row, which a rerun of a lost
    # task repeats. Whole-row copies share that hash; the sort-merge join asked
    # for below is the kind whose oversized partitions AQE splits.
    is_hot = F.coalesce(F.xxhash64(fact_key).isin(hot), F.lit(False)) & F.col(fact_key).isNotNull() if hot else F.lit(False)
    settled = is_hot | F.col(fact_key).isNull()
    marked = fact.withColumns(
        {
            "_hot_key": F.when(is_hot, F.col(fact_key)),
            "_cold_key": F.when(~settled, F.col(fact_key)),
            "_spread": F.when(settled, F.pmod(F.xxhash64(*[F.col(c) for c in fact.columns]), F.lit(salts))).otherwise(-1),
        }
    )
    side = dim.select(
        F.col(dim_key).alias("_cold_key"),
        F.lit(-1).cast("bigint").alias("_spread"),
        *[F.col(v).alias(f"_cold_{v}") for v in values],
    ).hint("merge")
    joined = marked.join(side, ["_cold_key", "_spread"], "left")
    found = {v: F.col(f"_cold_{v}") for v in values}
    if hot:
        # The dimension has one row per key, so this side has at most
        # HOT_FRACTION rows.
        few = dim.where(F.xxhash64(dim_key).isin(hot)).select(
            F.col(dim_key).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values]
        )
        joined = joined.join(F.broadcast(few), "_hot_key", "left")
        found = {v: F.coalesce(F.col(f"_hot_{v}"), c) for v, c in found.items()}
    return joined.select(*fact.columns, *[c.alias(v) for v, c in found.items()])


def anti_existing_ids(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose id is not in `existing`."""
    return candidates.join(existing.select("id"), "id", "left_anti")


def present_in(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("id"), "id", "left_semi")


def id_overlap(alerts: DataFrame, zero_day: DataFrame) -> DataFrame:
    """Distinct id counts and ranges on both sides, and how many ids they share."""
    a = alerts.select("id").distinct().withColumn("in_a", F.lit(1))
    z = zero_day.select("id").distinct().withColumn("in_z", F.lit(1))
    both = a.join(z, "id", "full")
    in_a, in_z = F.col("in_a").isNotNull(), F.col("in_z").isNotNull()
    return both.agg(
        F.count_if(in_a).alias("alert_ids"),
        F.count_if(in_z).alias("zero_day_ids"),
        F.count_if(in_a & in_z).alias("overlap_ids"),
        F.min(F.when(in_a, F.col("id"))).alias("alert_min_id"),
        F.max(F.when(in_a, F.col("id"))).alias("alert_max_id"),
        F.min(F.when(in_z, F.col("id"))).alias("zero_day_min_id"),
        F.max(F.when(in_z, F.col("id"))).alias("zero_day_max_id"),
    )


def intersect_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def except_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    # Copies collapse first, so the join meets each id once; one shuffle serves both.
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def score_lookup(alerts: DataFrame, zero_day: DataFrame) -> DataFrame:
    """Alerts with the novelty score saved for their id, null where none is.

    An id that was saved several times has one score here, its highest.
    """
    saved = zero_day.groupBy("id").agg(F.max("zero_day_score").alias("zero_day_score"))
    return lookup(alerts, saved, "id", "id")


def internal_membership(
    df: DataFrame,
    ip_column: str,
    internal: DataFrame,
    out: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """1 where the address is in the internal list, else 0; null counts as 0."""
    flagged = internal.select(F.col("ip").alias("_ip"), F.lit(1).alias("_member"))
    joined = lookup(df, flagged, ip_column, "_ip", broadcast_rows, small)
    return joined.withColumn(out or f"{ip_column}_is_internal", F.coalesce("_member", F.lit(0))).drop("_member")
