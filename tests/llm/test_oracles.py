"""Operators' queries against their SQL on the smallest tables."""

import os

import pytest

from tests.oracle_check import compare, connect
from tidemark.llm import queries
from tidemark.llm.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", sorted(k for k in ORACLES if k.startswith("op")))
def test_query_matches_sql(spark, name):
    ok, why, rows = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ok and rows > 0, why


def test_one_query_for_each_operator():
    assert queries and sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 14))
