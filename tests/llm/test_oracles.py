from __future__ import annotations

import sys
from pathlib import Path

import pytest
from alertloom.llm.queries import all_queries

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in all_queries().items() if sql])
def test_query_equals_its_sql(spark, name):
    run, sql = all_queries()[name]
    assert compare(connect(SF), run(spark, SF), sql) == []


@pytest.mark.parametrize("number", range(1, 14))
def test_each_operator_has_a_query(number):
    assert len([n for n in all_queries() if n.startswith(f"op{number}_")]) == 1
