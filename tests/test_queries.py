"""Each registered query against its SQL on the smallest tables."""

import pytest
from oracle import assert_same, connect

from tessera.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, con, name):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLE_SQL:
        assert_same(df, con, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["srt01_natural_order", "srt02_same_order"])
def test_places_without_a_window_over_the_table(spark, small, name):
    assert "Window" not in catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
