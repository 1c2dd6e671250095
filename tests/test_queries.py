"""Every registered query against its SQL on the smallest tables."""

import pytest

from hashloom import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(name, matches):
    matches(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 200
