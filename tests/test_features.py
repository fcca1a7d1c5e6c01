from __future__ import annotations

import ipaddress
import random
from datetime import datetime

from alertloom.functions import addresses, traffic
from alertloom.functions.timeparts import add_time_features
from alertloom.operators.frequency import add_frequency_features, value_frequency
from alertloom.plans.preprocess import add_ip_features, engineer
from alertloom.sources.scans import internal_ip_list
from pyspark.sql import functions as F

EDGE_IPS = [
    None, "", "None", "nan", "0.0.0.0", "10.1.2.3", "172.15.0.1", "172.16.0.1", "172.31.0.1", "172.32.0.1",
    "192.168.1.1", "169.254.1.1", "127.0.0.1", "8.8.8.8", "010.1.1.1", "256.1.1.1", "::1", "::", "2001:db8::1",
    "2a00:1450::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "fe80::1%eth0", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2", "1:2:3:4:5:6:1.2.3.4", "64:ff9b:1::1", "100::1", "2001:1::1", "2001:1::3",
    "2001:20::5", "4000::1", "fc00::", "192.0.0.9", "192.0.0.8", "192.0.0.170", "255.255.255.255", "240.0.0.1", "1.2.3",
    "1.2.3.4.5", " 10.0.0.1", "12345::", "g::1", "2002::1", "2001:1ff::1", "2001:200::1", "::ffff:0:1", "not-an-ip",
]


def _internal(ip):
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return 0
    return int(a.is_private or a.is_loopback or a.is_link_local)


def _segment(ip):
    text = str(ip)
    if text in ("", "None", "nan", "0.0.0.0"):
        return "unknown"
    try:
        private = ipaddress.ip_address(text).is_private
    except ValueError:
        return text
    keep = 3 if private and not text.startswith("10.") else 2
    parts = text.split(".")
    return ".".join(parts[:keep]) if len(parts) >= keep else text


def test_addresses_match_standard_library(spark):
    rng = random.Random(7)
    ips = list(EDGE_IPS) + [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(1500)]
    for head in ["2001::", "fc12::", "fe80::", "ff02::", "::", "64::", "100::", "2a00::", "2002::"]:
        base = int(ipaddress.ip_address(head))
        ips += [str(ipaddress.ip_address(base | rng.getrandbits(rng.choice([112, 96, 64, 16])))) for _ in range(100)]
    df = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    got = df.select("ip", addresses.is_internal(F.col("ip")).alias("i"), addresses.segment(F.col("ip")).alias("s")).collect()
    wrong = [r for r in got if (r.i, r.s) != (_internal(r.ip), _segment(r.ip))]
    assert len(got) == len(ips) and not wrong, wrong[:5]


def test_internal_list_replaces_range_rule(spark, alerts):
    df = alerts({"src_ip": "8.8.8.8"}, {"src_ip": "192.168.1.1"}, {"src_ip": None})
    table = spark.createDataFrame([(1, "8.8.8.8")], "n int, internal_ip string")
    flags = [r[0] for r in add_ip_features(df, internal_ip_list(table)).orderBy("id").select("src_ip_is_internal").collect()]
    assert flags == [1, 0, 0]
    empty = internal_ip_list(table.limit(0))
    flags = [r[0] for r in add_ip_features(df, empty).orderBy("id").select("src_ip_is_internal").collect()]
    assert flags == [0, 1, 0]


def test_ip_column_is_the_first_known_name(spark):
    table = spark.createDataFrame([("x", "1.1.1.1", "2.2.2.2")], "address string, ip string, other string")
    assert internal_ip_list(table).first().ip == "1.1.1.1"
    assert internal_ip_list(table.select("other", "address").withColumnRenamed("address", "q")).first().ip == "2.2.2.2"


def test_work_hours(alerts):
    hours = [8, 9, 17, 18]
    df = alerts(*[{"event_time": datetime(2024, 1, 1, h)} for h in hours], {"event_time": None})
    got = [r[0] for r in add_time_features(df).orderBy("id").select("event_time_is_work_hour").collect()]
    assert got == [0, 1, 1, 0, 0]


def test_threat_bands(spark):
    df = spark.createDataFrame([(19,), (20,), (29,), (30,)], "t int")
    assert [r[0] for r in df.orderBy("t").select(traffic.threat_band(F.col("t"))).collect()] == ["低危", "中危", "中危", "高危"]


def test_ports_and_numbers(spark):
    df = spark.createDataFrame([(None,), ("abc",), ("443",), ("3389",), ("1d",), ("nan",), (" 80 ",)], "src_port string")
    rows = traffic.add_port_features(traffic.coerce_numeric(df)).collect()
    assert [(r.src_port, r.src_port_service, r.src_port_is_common) for r in rows] == [
        (0.0, "other", 0), (0.0, "other", 0), (443.0, "HTTPS", 1), (3389.0, "other", 0), (0.0, "other", 0), (0.0, "other", 0), (80.0, "HTTP", 1),
    ]


def test_zero_packets_and_nulls(alerts):
    df = alerts({"packets_to_server": 0, "packets_to_client": 0}, {"bytes_to_server": None, "category": None})
    rows = engineer(df).orderBy("id").collect()
    assert rows[0].avg_packet_size == 0.0
    assert rows[1].total_bytes == 500 and rows[1].category == "unknown"


def test_frequency_ignores_nulls_in_the_total(alerts):
    df = alerts({"src_ip": "a"}, {"src_ip": "a"}, {"src_ip": "b"}, {"src_ip": None})
    table = {r.value: r.freq for r in value_frequency(df, ["src_ip"]).collect()}
    assert table == {"a": 2 / 3, "b": 1 / 3}
    got = [r[0] for r in add_frequency_features(df, ["src_ip"]).orderBy("id").select("src_ip_freq").collect()]
    assert got == [2 / 3, 2 / 3, 1 / 3, 0.0]


def test_shuffle_path_gives_the_same_features(views):
    columns = ["id", "src_ip_freq", "signature_freq", "category_freq"]
    small = engineer(views.alerts).select(columns)
    large = engineer(views.alerts, broadcast_rows=0).select(columns)
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


def test_empty_input_keeps_the_schema(views):
    empty = engineer(views.alerts.limit(0))
    assert empty.count() == 0
    assert set(engineer(views.alerts).columns) == set(empty.columns)


def test_cjk(spark):
    df = spark.createDataFrame([("abc", "攻击", 1), ("x", None, 2)], "a string, b string, n int")
    assert {r.column_name: r.has_cjk for r in traffic.has_cjk(df).collect()} == {"a": False, "b": True}
