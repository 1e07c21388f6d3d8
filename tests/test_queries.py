"""Every query with SQL gives the SQL's rows, over whole tables."""

import pytest

from heddle.queries import oracle_sql, queries
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, con, name):
    found, _, _ = oracle.difference(spark, con, queries()[name], oracle_sql()[name], SF)
    assert found is None


def test_plans(spark):
    """The seek and the filters reach the scan, columns are pruned, and a limited child is cut inside the window."""

    def plan(name):
        return queries()[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    assert "GreaterThan(conv_id,5)" in plan("connection_composite_after") and "TakeOrderedAndProject" in plan("connection_after")
    assert "EqualTo(o_custkey,7)" in plan("rbac_row_filter")
    assert "ReadSchema: struct<o_totalprice:double" not in plan("rel_to_one")
    assert "WindowGroupLimit" in plan("rel_to_many_limited")
