from __future__ import annotations

import pandas as pd
import pytest
from alertloom.session import ship_package
from edge_rows import CLASHING, EDGE, EDGE_SCHEMA

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def documents():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, EDGE_SCHEMA).withColumns({c: F.lit("own") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
