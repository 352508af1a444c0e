"""Every registered query against its SQL at the smallest scale."""

import os

import pytest
from oracle_check import compare, connect

from workload import load_all

QUERIES, ORACLES = load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message, rows = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert ok, message


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 190
