import pytest
from conftest import check_against_sql

from postmill.plans import data_queries, posting_queries

QUERIES, SQL = data_queries.QUERIES | posting_queries.QUERIES, data_queries.SQL | posting_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    check_against_sql(spark, duck, QUERIES, SQL, name)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
