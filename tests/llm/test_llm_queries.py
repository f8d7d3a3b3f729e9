import pytest
from conftest import check_against_sql

from postmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    check_against_sql(spark, duck, queries.QUERIES, queries.SQL, name)
