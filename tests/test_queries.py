"""Every query against its SQL, or at least running, on the smallest tables."""

import compare
import pytest

from textloom.plans import feature_queries, table_queries, text_queries

SF = "/root/testdata/sf0.001"
QUERIES = text_queries.QUERIES | table_queries.QUERIES | feature_queries.QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    query, sql = QUERIES[name]
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert compare.differences(spark, query, sql, SF) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
