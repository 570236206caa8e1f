"""Every core query at the smallest scale, against its SQL where it has one."""

import pytest

from lanewise import catalog
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert_same(df, duck, catalog.ORACLES[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).schema.fieldNames()


def test_ranking_plan_prunes_and_limits(spark):
    plan = catalog.QUERIES["ranking_filtered"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "PushedFilters: [IsNotNull" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
