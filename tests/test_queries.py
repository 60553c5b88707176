"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, duck

from samplemill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    _, problem = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, con, name):
    got, _ = compare(spark, con, SF, QUERIES[name], None)
    assert got


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
