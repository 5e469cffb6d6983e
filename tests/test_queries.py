"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from varlake.plans.catalog import all_queries
from varlake.plans.oracle import all_oracles

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    result = all_queries()[name](spark, SF)
    assert difference(result, duck, all_oracles()[name]) is None
    assert not result.isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
