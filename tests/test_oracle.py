"""Every query with SQL equals it on the smallest tables."""

import oracle
import pytest

from gaugeworks.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    got = oracle.differences(spark, con, catalogue.QUERIES[name], catalogue.ORACLE[name], sf)
    assert got in ("", "close"), got


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
