"""Each registered query of the graph engine against its SQL on the small tables."""

import pytest

from graphspark import catalogue, directory_queries, questions  # noqa: F401  (they register queries)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, duck, small, same):
    same(catalogue.QUERIES[name](spark, small), duck.sql(catalogue.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, small):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry_is_importable(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["src", "dst", "edge_types", "flow"]
