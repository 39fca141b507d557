import pytest
from compare import same

from emberlog.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, small, name):
    same(queries()[name](spark, small), oracle_sql()[name], small)
