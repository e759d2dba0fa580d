import pytest

from passageloom.plans import more_queries, queries, run_queries

QUERIES = queries.QUERIES | more_queries.QUERIES | run_queries.QUERIES
SQL = queries.ORACLE_SQL | more_queries.ORACLE_SQL | run_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
