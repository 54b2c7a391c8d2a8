"""Queries of the subpackage that have SQL give the SQL's rows."""

import pytest
from compare import difference

from evispark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, data, name):
    assert not difference(QUERIES[name](spark, data), ORACLE_SQL[name], data)
