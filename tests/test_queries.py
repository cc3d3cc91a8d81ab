"""Every registered query of the library runs; those with SQL have its rows."""

import pytest

from sylvameter.plans import catalogue, evidence, flows, search

QUERIES = catalogue.QUERIES | search.QUERIES | evidence.QUERIES | flows.QUERIES
SQL = catalogue.ORACLE_SQL | search.ORACLE_SQL | evidence.ORACLE_SQL | flows.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, same_rows, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        same_rows(df, SQL[name])
    else:
        assert df.count() > 0


def test_sql_is_for_queries_only():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["axis", "value", "n"]
