import pytest
from compare import same

from emberlog.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    same(QUERIES[name](spark, small), ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
