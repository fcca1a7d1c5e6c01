"""Port, traffic, number and text features as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.schemas import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS, PORT_COLUMNS

# Well-known ports.
COMMON_PORTS = {
    21: "FTP",
    22: "SSH",
    23: "Telnet",
    25: "SMTP",
    53: "DNS",
    80: "HTTP",
    443: "HTTPS",
    3306: "MySQL",
}
# Lower bounds of the threat bands.
THREAT_BANDS = [(30, "高危"), (20, "中危")]
LOWEST_BAND = "低危"
CJK_PATTERN = "[\\u4e00-\\u9fff]"
_NUMBER_TEXT = "^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$"


def port_service(port: Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(COMMON_PORTS.items())])
    return F.coalesce(F.try_element_at(names, port.cast("int")), F.lit("other"))


def port_is_common(port: Column) -> Column:
    return F.coalesce(port.isin(list(COMMON_PORTS)).cast("int"), F.lit(0))


def add_port_features(df: DataFrame) -> DataFrame:
    added: dict[str, Column] = {}
    for column in PORT_COLUMNS:
        if column in df.columns:
            added[f"{column}_service"] = port_service(F.col(column))
            added[f"{column}_is_common"] = port_is_common(F.col(column))
    return df.withColumns(added) if added else df


def add_traffic_features(df: DataFrame) -> DataFrame:
    """Total bytes and packets of both directions, and mean packet size."""
    have = set(df.columns)
    if {"bytes_to_server", "bytes_to_client"} <= have:
        df = df.withColumn("total_bytes", F.col("bytes_to_server") + F.col("bytes_to_client"))
    if {"packets_to_server", "packets_to_client"} <= have:
        df = df.withColumn("total_packets", F.col("packets_to_server") + F.col("packets_to_client"))
    if {"total_bytes", "total_packets"} <= set(df.columns):
        size = F.when(F.col("total_packets") > 0, F.col("total_bytes") / F.col("total_packets")).otherwise(F.lit(0.0))
        df = df.withColumn("avg_packet_size", size)
    return df


def fill_missing(df: DataFrame) -> DataFrame:
    """'unknown' for missing categories, 0 for missing numbers; present columns only."""
    values: dict[str, object] = {c: "unknown" for c in CATEGORICAL_COLUMNS if c in df.columns}
    values |= {c: 0 for c in NUMERIC_COLUMNS if c in df.columns and not isinstance(df.schema[c].dataType, T.StringType)}
    return df.fillna(values) if values else df


def to_number(df: DataFrame, column: str) -> Column:
    """Number or 0: text that is no number, and missing values, become 0."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        readable = F.when(F.col(column).rlike(_NUMBER_TEXT), F.expr(f"try_cast(trim({column}) AS DOUBLE)"))
        return F.coalesce(readable, F.lit(0.0))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.coalesce(F.nanvl(F.col(column), F.lit(None).cast(kind)), F.lit(0).cast(kind))
    return F.coalesce(F.col(column), F.lit(0).cast(kind))


def coerce_numeric(df: DataFrame) -> DataFrame:
    columns = [c for c in NUMERIC_COLUMNS + PORT_COLUMNS if c in df.columns]
    return df.withColumns({c: to_number(df, c) for c in columns}) if columns else df


def threat_band(level: Column) -> Column:
    band = F.when(level >= THREAT_BANDS[0][0], THREAT_BANDS[0][1])
    for bound, name in THREAT_BANDS[1:]:
        band = band.when(level >= bound, name)
    return band.otherwise(LOWEST_BAND)


def has_cjk(df: DataFrame) -> DataFrame:
    """One row per text column: does any value hold a Chinese character?"""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    flags = df.agg(*[F.coalesce(F.max(F.col(c).rlike(CJK_PATTERN)), F.lit(False)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("has_cjk")) for c in columns]))
    return flags.select(pairs.alias("_pair")).select("_pair.*")
