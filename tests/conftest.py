from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from alertloom.schemas import ALERT_SCHEMA  # noqa: E402
from alertloom.session import local_session  # noqa: E402
from alertloom.sources.views import Views  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4, memory="6g")


@pytest.fixture(scope="session")
def views(spark):
    return Views(spark, SMALL)


@pytest.fixture(scope="session")
def medium(spark):
    return Views(spark, MEDIUM)


DEFAULTS = {
    "event_time": datetime(2024, 1, 5, 10, 0),
    "event_type": "scan",
    "device_name": "d",
    "device_ip": "10.0.0.1",
    "threat_level": 20,
    "category": "SQL注入",
    "attack_function": "f",
    "attack_step": "s",
    "signature": "sig",
    "src_ip": "192.168.1.1",
    "src_port": 1000,
    "src_mac": "m",
    "dst_ip": "192.168.1.2",
    "dst_port": 80,
    "dst_mac": "m",
    "protocol": "TCP",
    "packets_to_server": 10,
    "packets_to_client": 10,
    "bytes_to_server": 1000,
    "bytes_to_client": 500,
    "created_at": datetime(2024, 1, 5, 10, 5),
}


@pytest.fixture(scope="session")
def alerts(spark):
    """Maker of alert frames: each row is the default row with some values changed."""

    def make(*rows: dict):
        filled = [{"id": i, **DEFAULTS, **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r[f.name] for f in ALERT_SCHEMA.fields) for r in filled], ALERT_SCHEMA)

    return make
