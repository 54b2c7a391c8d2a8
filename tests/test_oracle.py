"""Every query that has SQL gives the SQL's rows."""

import pytest
from compare import difference

from evispark.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, data, name):
    assert not difference(QUERIES[name](spark, data), ORACLE_SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
