"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_point
from logsluice.plans.registry import ORACLES, QUERIES
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), ORACLES[name], con) == []


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 0
