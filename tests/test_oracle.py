"""Every registered query beside its SQL, on the whole small tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as contract
from check_oracle import compare, connect

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    problems = [p for p in compare(con, QUERIES[key](spark, SMALL), ORACLES[key]) if not p.startswith("note")]
    assert not problems, problems


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, key):
    assert QUERIES[key](spark, SMALL).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["day_of_week", "hour_of_day", "n", "max_count"]
