import __spark_entry__ as entry
import pytest
from corpusloom.plans import construction, core_problems, evaluation, manifests, measures
from sqlcheck import SF, same_rows

MODULES = (core_problems, construction, manifests, evaluation, measures)
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
here = pytest.mark.skipif(not SF.exists(), reason="the test tables aren't here")


@here
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same_rows(spark, QUERIES[name], SQL[name])


@here
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "num_pairs" in df.columns


def test_catalogues():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert set(QUERIES) == set(SQL)
