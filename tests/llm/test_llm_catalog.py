import pytest

from oracle import DATA, assert_same
from pluvion.llm import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query = catalog.queries()[name]
    if name in SQL:
        assert_same(spark, name, query, SQL[name])
    else:
        assert query(spark, DATA).limit(1).count() == 1
