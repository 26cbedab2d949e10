"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from check_oracle import compare, connect
from obsgauge.plans.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Empty at this size: no labelled incident is detected, no attribute reaches the strict limit.
MAY_BE_EMPTY = {"price_findings", "remediation_params", "verify_cardinality",
                "detections", "flappiness", "set_detections", "diff_lost", "diff_gained", "diff_ttd", "attributed_firings"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLE:
        assert QUERIES[name](spark, FOLDER).count() > 0
        return
    problem = compare(spark, con, FOLDER, name, QUERIES[name], ORACLE[name])
    assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY), problem


def test_names_follow_the_rules():
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]
    assert set(ORACLE) <= set(QUERIES)
