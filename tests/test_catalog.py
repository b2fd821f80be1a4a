"""Every core query against its SQL, or, where there is none, that it gives rows (at the next size, where the smallest gives none)."""

import pytest

from oracle import DATA, NEXT, assert_same
from pluvion import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query = catalog.queries()[name]
    if name in SQL:
        assert_same(spark, name, query, SQL[name])
    else:
        assert any(query(spark, data).limit(1).count() == 1 for data in (DATA, NEXT))


def test_entry_has_no_need_of_the_subpackage(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
