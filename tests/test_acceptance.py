"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from acceptance.catalog import CHECKS
from acceptance.compare import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, con, name):
    assert differences(spark, con, name, SF) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(CHECKS) | set(entry_points.oracle_sql()) <= set(entry_points.queries())
