"""From raw alerts to the engineered frame and the feature vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions import addresses
from alertloom.functions.timeparts import add_time_features
from alertloom.functions.traffic import add_port_features, add_traffic_features, coerce_numeric, fill_missing
from alertloom.operators.frequency import add_frequency_features, value_frequency
from alertloom.operators.joins import internal_membership
from alertloom.schemas import FREQUENCY_COLUMNS, IP_COLUMNS
from alertloom.storage import BROADCAST_ROWS, fits, materialise


def add_ip_features(df: DataFrame, internal: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Internal flags, segments and the same-segment flag.

    A non-empty internal list replaces the range rule: then only membership
    counts. With no list, or an empty one, the range rule applies.
    """
    columns = [c for c in IP_COLUMNS if c in df.columns]
    listed = False
    if internal is not None:
        # Written once: the list is looked at three times and its size checked.
        internal = materialise(internal, "internal")
        listed, small = not internal.isEmpty(), fits(internal, broadcast_rows)
    for c in columns:
        if listed:
            df = internal_membership(df, c, internal, small=small)
        else:
            df = df.withColumn(f"{c}_is_internal", addresses.is_internal(F.col(c)))
    df = df.withColumns({f"{c}_segment": addresses.segment(F.col(c)) for c in columns})
    if {"src_ip", "dst_ip"} <= set(columns):
        df = df.withColumn("same_segment", addresses.same_segment(F.col("src_ip_segment"), F.col("dst_ip_segment")))
    return df


def engineer(
    alerts: DataFrame,
    internal: DataFrame | None = None,
    frequencies: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
    frozen: DataFrame | None = None,
) -> DataFrame:
    """Cleaned alerts with all time, address, port, frequency and traffic features.

    Frequencies are those of this batch, at fit time and at scoring time alike,
    unless a frozen frequency table is given.
    """
    df = coerce_numeric(fill_missing(alerts))
    df = add_time_features(df)
    df = add_ip_features(df, internal, broadcast_rows)
    df = add_port_features(df)
    if frequencies:
        df = add_frequency_features(df, broadcast_rows=broadcast_rows, frozen=frozen)
    return add_traffic_features(df)


def frequency_table(alerts: DataFrame) -> DataFrame:
    """Frequencies of the cleaned values of these alerts, to be kept with a model."""
    wanted = [c for c in FREQUENCY_COLUMNS if c in alerts.columns]
    return materialise(value_frequency(coerce_numeric(fill_missing(alerts)), wanted), "frequencies")
