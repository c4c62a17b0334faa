"""Every registered query with an oracle equals its DuckDB SQL (sf0.001).

Set TRUELINE_ORACLE_SF to check another scale (the driver uses sf0.01).
"""
import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

SF = os.environ.get("TRUELINE_ORACLE_SF", SF_SMALL)
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_registered_with_a_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert all(callable(f) for f in QUERIES.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert res["ok"], res
