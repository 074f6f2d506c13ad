"""Every registered query against its SQL, and a look at the plans."""

import pytest

from agestack.plans import catalog
from oracle import SF
from oracle import check, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    diff, n, _ = check(spark, con, SF, name, catalog.QUERIES[name], catalog.SQL.get(name))
    assert not diff, diff


CHEAP = [n for n in catalog.QUERIES if n.startswith(("src", "prj", "flt", "jn", "set", "agg", "win", "fn"))]


@pytest.mark.parametrize("name", CHEAP)
def test_no_nested_loops(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pruned_scan(spark):
    """Only the columns in use are read, and filters reach the scan."""
    plan = catalog.QUERIES["jn6_semi_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_brand,Brand#2)" in plan
    assert "l_shipdate" not in plan
