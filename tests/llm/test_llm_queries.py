"""The registered queries against their SQL, where they have one."""

import os

import pytest
from compare import connect, difference

from varlake.llm.queries import oracles, queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_one_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in queries()] == list(range(1, 14))
    assert set(oracles()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query(spark, name):
    assert difference(queries()[name](spark, SF), connect(SF), oracles()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracles())))
def test_query_has_a_row_for_each_document(spark, name):
    ids = {r["doc_id"] for r in queries()[name](spark, SF).select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
