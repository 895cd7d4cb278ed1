"""Every query with SQL gives DuckDB's rows on the same tables."""

import pytest
from compare import both

from rasterloom import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, sf, name):
    got, want = both(spark, sf, plans.QUERIES[name], plans.SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).collect()[0]
    assert row.n == row.tp + row.tn + row.fp + row.fn > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
