import pytest

from mosaique.llm import queries
from tests.oracle import check


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_rows_as_sql(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name])
