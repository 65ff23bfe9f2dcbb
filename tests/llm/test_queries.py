"""Registered queries against their SQL."""

import pytest

import __spark_entry__ as entry
from check import compare, duck
from curvemill.llm import registered

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query_matches_sql(spark, name):
    status, text, _, _ = compare(spark, duck(SF), registered.QUERIES[name], registered.ORACLES[name], SF)
    assert status == "ok", text


def test_all_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(registered.ORACLES) <= set(entry.oracle_sql())
