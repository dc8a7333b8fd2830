"""Queries of the text operators against their SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as contract
from tests.test_queries import FOLDER, duck, table
from wardline.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    got = QUERIES[name](spark, str(FOLDER)).toPandas()
    expected = duck(FOLDER).sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert table(got) == table(expected)


def test_all_registered():
    assert set(QUERIES) < set(contract.queries())
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES}
    assert numbers == set(range(1, 14))
