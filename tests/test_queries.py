"""Every query against its SQL at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
