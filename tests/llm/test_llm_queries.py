import pytest
from corpusloom.llm.queries import QUERIES, SQL
from sqlcheck import SF, same_rows


@pytest.mark.skipif(not SF.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same_rows(spark, QUERIES[name], SQL[name])


def test_names():
    assert set(SQL) <= set(QUERIES)
