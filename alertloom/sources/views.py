"""Alert tables derived from the `events` test table.

The expressions are written once and rendered for Spark and for the checking
engine, so both sides look at the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators.asof import resolve_as_of
from alertloom.schemas import ALERT_COLUMNS

# Tokens: {S} text type, {K} key out of props, {ADD} created_at.
SPARK_TOKENS = {
    "S": "string",
    "K": "cast(get_json_object(props, '$.k') as int)",
    "ADD": "timestampadd(MINUTE, k, ts)",
}
DUCK_TOKENS = {
    "S": "varchar",
    "K": "cast(json_extract_string(props, '$.k') as int)",
    "ADD": "ts + to_minutes(k)",
}

# How each alert column comes out of an event. Three of the categories are those left out by default.
ALERT_EXPRESSIONS = {
    "id": "event_id",
    "event_time": "ts",
    "event_type": "CASE WHEN k % 17 = 0 THEN NULL ELSE event_type END",
    "device_name": "concat('Server-', cast(user_id % 10 + 1 as {S}))",
    "device_ip": "concat('10.0.', cast(user_id % 16 as {S}), '.', cast(user_id % 250 + 1 as {S}))",
    "threat_level": "cast((k % 4 + 1) * 10 as int)",
    "category": "CASE k % 8 WHEN 0 THEN '严重漏洞' WHEN 1 THEN '勒索软件' WHEN 2 THEN '数据泄露' WHEN 3 THEN 'port sweep' "
    "WHEN 4 THEN 'credential stuffing' WHEN 5 THEN 'dns tunnel' WHEN 6 THEN 'beaconing' ELSE NULL END",
    "attack_function": "CASE k % 7 WHEN 0 THEN 'probe' WHEN 1 THEN 'lure' WHEN 2 THEN 'drop' WHEN 3 THEN 'break-in' "
    "WHEN 4 THEN 'foothold' WHEN 5 THEN 'spread' ELSE 'damage' END",
    "attack_step": "concat('步骤', cast(k % 7 + 1 as {S}))",
    "signature": "concat('SIG-', cast(1000 + k % 40 as {S}))",
    "src_ip": "CASE WHEN event_id % 10 = 0 THEN concat(cast(11 + user_id % 150 as {S}), '.', cast(k as {S}), '.', "
    "cast(event_id % 250 as {S}), '.7') "
    "WHEN event_id % 10 = 1 THEN concat('10.', cast(k as {S}), '.', cast(user_id % 250 as {S}), '.9') "
    "WHEN event_id % 10 = 2 THEN concat('172.', cast(14 + k % 20 as {S}), '.', cast(user_id % 250 as {S}), '.5') "
    "WHEN event_id % 10 = 3 THEN concat('203.0.113.', cast(k as {S})) "
    "WHEN event_id % 10 = 4 AND k < 10 THEN NULL "
    "WHEN event_id % 10 = 5 AND k < 5 THEN 'not-an-ip' "
    "WHEN event_id % 10 = 5 AND k < 10 THEN concat('2001:db8::', cast(k as {S})) "
    "WHEN event_id % 10 = 5 AND k < 15 THEN concat('2a00:1450::', cast(k as {S})) "
    "WHEN event_id % 10 = 5 AND k < 20 THEN '0.0.0.0' "
    "ELSE concat('192.168.', cast(user_id % 16 as {S}), '.', cast(user_id % 250 + 1 as {S})) END",
    "src_port": "cast(CASE WHEN event_id % 13 = 0 THEN 22 ELSE 1024 + event_id % 64511 END as int)",
    "src_mac": "concat('00:1B:44:', cast(10 + user_id % 90 as {S}), ':', cast(10 + k % 90 as {S}), ':10')",
    "dst_ip": "concat('192.168.', cast(k % 16 as {S}), '.', cast(event_id % 250 + 1 as {S}))",
    "dst_port": "CASE k % 9 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 21 WHEN 4 THEN 25 WHEN 5 THEN 53 "
    "WHEN 6 THEN 3389 WHEN 7 THEN 3306 ELSE NULL END",
    "dst_mac": "concat('00:1A:2B:', cast(10 + k % 90 as {S}), ':', cast(10 + user_id % 90 as {S}), ':20')",
    "protocol": "CASE k % 6 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'HTTP' WHEN 3 THEN 'HTTPS' WHEN 4 THEN 'SSH' "
    "ELSE NULL END",
    "packets_to_server": "cast(CASE WHEN k % 20 = 0 THEN 0 ELSE cast(floor(value) as bigint) % 1000 END as bigint)",
    "packets_to_client": "cast(CASE WHEN k % 20 = 0 THEN 0 ELSE k END as bigint)",
    "bytes_to_server": "cast(floor(value * 100) as bigint)",
    "bytes_to_client": "cast(k * 37 as bigint)",
    "created_at": "{ADD}",
}

_BASE_COLUMNS = ", ".join(c for c in ALERT_COLUMNS if c != "created_at")
_BASE_COLUMNS_SHIFTED = ", ".join("id + 1000000 AS id" if c == "id" else c for c in ALERT_COLUMNS if c != "created_at")

# The other tables of the data model, each a function of the whole alert table.
# The modulo terms only decide which alert belongs to which table (no alert
# table ships with the test data); queries read all rows of every table.
DERIVED_SQL = {
    "baseline_alerts": "SELECT *, created_at + INTERVAL '1' DAY AS added_to_baseline_at FROM {alerts} "
    "WHERE id % 3 = 0 AND threat_level <= 20",
    "zero_day_alerts": f"SELECT {_BASE_COLUMNS}, created_at - (id % 4) * INTERVAL '20' DAY AS created_at, "
    "cast(round(0.5e0 + cast(id % 500 as double) / 1000, 3) as double) AS zero_day_score FROM {alerts} WHERE id % 29 = 0 "
    f"UNION ALL SELECT {_BASE_COLUMNS_SHIFTED}, created_at, cast(0.9 as double) AS zero_day_score "
    "FROM {alerts} WHERE id % 290 = 0",
    "ip_address": "SELECT DISTINCT src_ip AS ip_address FROM {alerts} WHERE src_ip LIKE '192.168.%' AND id % 2 = 0",
    # Every alert leaves one entry in the state log of one of four components.
    "state_log": "SELECT CASE id % 4 WHEN 0 THEN 'last_baseline_data_update' WHEN 1 THEN 'last_baseline_model_update' "
    "WHEN 2 THEN 'last_zero_day_model_update' ELSE 'last_zero_day_detection_update' END AS config_key, "
    "CASE WHEN id % 4 = 2 THEN concat('bad text ', signature) "
    "ELSE concat(cast(cast(created_at as date) as {S}), ' 0', substr(cast(threat_level as {S}), 1, 1), ':15:00') END AS config_value, "
    "created_at AS last_updated, id AS entry_id FROM {alerts}",
}


def alert_expressions(tokens: dict[str, str]) -> dict[str, str]:
    return {name: _fill(text, tokens) for name, text in ALERT_EXPRESSIONS.items()}


def _fill(text: str, tokens: dict[str, str]) -> str:
    for token, value in tokens.items():
        text = text.replace("{" + token + "}", value)
    return text


def derived_sql(name: str, tokens: dict[str, str]) -> str:
    return _fill(DERIVED_SQL[name], tokens)


def alerts_from_events(events: DataFrame) -> DataFrame:
    """Alert rows as a projection of the events table (works on streams too)."""
    keyed = events.withColumn("k", F.expr(SPARK_TOKENS["K"]))
    return keyed.select(*[F.expr(text).alias(name) for name, text in alert_expressions(SPARK_TOKENS).items()])


class Views:
    """The alert tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    @cached_property
    def alerts(self) -> DataFrame:
        return alerts_from_events(self.events)

    def _derived(self, name: str) -> DataFrame:
        return self.spark.sql(derived_sql(name, SPARK_TOKENS), alerts=self.alerts)

    @cached_property
    def baseline(self) -> DataFrame:
        return self._derived("baseline_alerts")

    @cached_property
    def zero_day(self) -> DataFrame:
        return self._derived("zero_day_alerts")

    @cached_property
    def internal_ips(self) -> DataFrame:
        return self._derived("ip_address")

    @cached_property
    def state_log(self) -> DataFrame:
        return self._derived("state_log")

    @cached_property
    def as_of(self) -> str:
        """Latest creation time: the fixed 'now' of every window on created_at."""
        return resolve_as_of(self.alerts, "created_at")

    @cached_property
    def as_of_event(self) -> str:
        return resolve_as_of(self.alerts, "event_time")


def duck_prelude() -> str:
    """CTEs giving the checking engine the same tables."""
    alerts = ",\n ".join(f"{text} AS {name}" for name, text in alert_expressions(DUCK_TOKENS).items())
    parts = [f"alerts AS (SELECT {alerts} FROM (SELECT *, {DUCK_TOKENS['K']} AS k FROM events) e)"]
    for name in DERIVED_SQL:
        parts.append(f"{name} AS ({derived_sql(name, DUCK_TOKENS).replace('{alerts}', 'alerts')})")
    parts.append("p AS (SELECT max(created_at) AS as_of, max(event_time) AS as_of_event FROM alerts)")
    return "WITH " + ",\n".join(parts)


def oracle(select: str, ctes: str = "") -> str:
    """A full oracle text: shared CTEs, the query's own CTEs, then its select."""
    head = duck_prelude()
    if ctes:
        head = f"{head},\n{ctes}"
    return f"{head}\n{select}"
