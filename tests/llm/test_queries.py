import pytest

from pagelens.llm import queries
from tests import oracle

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    oracle.check(spark, data, queries.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_runs(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
