"""Every registered query against its SQL, whole results on the small tables."""

import pytest

import __spark_entry__ as contract
from compare import differences, duck

SF = "/root/testdata/sf0.001"
# Results too small or empty at this scale are compared at sf0.01 by `python tests/compare.py`.
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert contract.entry(spark).count() == 15


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = differences(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem in (None, "both sides are empty")
