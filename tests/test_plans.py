"""Physical plans: no all-pairs joins, one exchange for frames of one key, narrow scans."""

from pathlib import Path

import pytest

from tremorlake import plans  # noqa: F401
from tremorlake.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


def plan(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c03_bbox_join", "c04_bbox_or_global", "c07_exists_forward", "c10_calendar_lag", "c17_nearest_event", "c18_epoch_join", "d03_regional_field", "h02_permuted_epoch", "h13_window_edges", "h24_strain"])
def test_joins_have_keys(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name,most", [("e01_rolling", 2), ("e03_lags", 2), ("e08_iqr_anomaly", 2), ("e10_quiescence_foreshock", 6)])
def test_frames_share_an_exchange(spark, name, most):
    p = plan(spark, name)
    assert p.count("Exchange hashpartitioning") <= most


def test_scans_are_narrow(spark):
    p = plan(spark, "b04_time_split")
    assert "ReadSchema: struct<o_orderdate" in p and "o_totalprice" not in p
    assert "EqualTo(l_returnflag,R)" in plan(spark, "a24_new_only")


@pytest.mark.parametrize("name", ["b09_haversine", "b24_anchor_date", "a01_quake_features", "c17_nearest_event", "h16_binary_metrics"])
def test_no_python_in_native_queries(spark, name):
    p = plan(spark, name)
    assert "Python" not in p and "Arrow" not in p and "Pandas" not in p
