"""Every query against its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

from trackloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF), con, registry.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs_twice_alike(spark, name):
    a, b = (sorted(map(str, registry.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b


def test_no_broadcast_of_whole_tables_and_no_cartesian_product(spark):
    for name in ("interval_lookup", "frame_labels", "match_segments", "argmax_overlap", "pair_ttc"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
