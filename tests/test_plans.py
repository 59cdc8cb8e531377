"""Physical-plan properties: pushdown, pruning, partial top-k, keyed joins,
and no nested-loop joins in the key queries."""

import pytest

from paths import SF01
from vigil.operators import extraction as X
from vigil.operators import grid, spatial
from vigil.sources import bindings as B


def _plan(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_language_filter_reaches_the_scan(spark):
    plan = _plan(X.article_window(B.articles(spark, SF01), start="2024-01-02", end="2024-01-05"))
    assert "EqualTo(lang,en)" in plan.split("PushedFilters:")[1].split("]")[0]


def test_incident_scan_reads_only_needed_columns(spark):
    plan = _plan(grid.grid_histogram(B.incidents(spark, SF01)))
    scans = [line for line in plan.split("\n") if "events.parquet" in line]
    assert scans and all("props" not in line and "value:" not in line for line in scans)


def test_topk_has_partial_group_limit(spark):
    fan = X.category_fanout(B.articles(spark, SF01), B.TEST_CATEGORY_TERMS)
    plan = _plan(X.category_topk(fan))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_distance_join_is_keyed(spark):
    train, actual = B.train_actual(spark, SF01)
    hs = grid.hotspots(train, as_of="2024-01-24")
    for plan in (_plan(spatial.within_distance(actual, hs, max_dist=0.005)), _plan(spatial.within_km(actual, hs, max_km=0.4))):
        assert "LeftSemi" in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["accuracy_series", "fpr_series", "accuracy_trend", "validation_run_detail"])
def test_runs_are_not_numbered_in_one_task(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF01))
    assert "Window" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["hotspots", "risk_amplifiers", "recommendations", "validation_run",
                                  "location_extract", "recent_effectiveness", "region_edges"])
def test_no_nested_loop_joins(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF01))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def _scans(plan, table):
    """Scans of a table in the final plan, node by node."""
    import re
    final = plan.split("+- == Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet [^\n]*" + table, final))


@pytest.mark.parametrize("name", ["location_extract", "relevance_tag", "geocode_left", "location_near_keyword"])
def test_text_is_scanned_once(spark, name):
    import __spark_entry__ as E
    assert _scans(_plan(E.queries()[name](spark, SF01)), "documents.parquet") == 1


@pytest.mark.parametrize("name", ["incident_build", "incident_projection", "ingest_counters"])
def test_incidents_read_the_written_category_rows(spark, name):
    import __spark_entry__ as E
    assert _scans(_plan(E.queries()[name](spark, SF01)), "documents.parquet") == 0
