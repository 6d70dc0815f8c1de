"""Plan-shape regression tests: the scale properties the operators are built for."""

import os

import pytest

from weekcast.plans import catalog
from weekcast.session import cluster_conf

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


# Tables that a query opens more often than the three retail tables.
_TABLE_READS = {"multi_scope_report": 4}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_engineer_features_one_shuffle_of_the_rows(spark):
    """One (store, dept) exchange feeds all windows, on the grain that grows; the context is joined after them."""
    from weekcast.operators import features as fe
    from weekcast.sources import adapter

    wide = adapter.retail_tables(spark, SF, grain="supplier")
    p = _plan(fe.engineer_features(wide["raw_sales"], wide["features"], wide["stores"]))
    windowed = [x for x in p.splitlines() if "Exchange hashpartitioning(store_id" in x and "dept_id" in x and "date" not in x.split("),")[0]]
    assert len(windowed) == 1


def test_no_job_before_an_action(spark):
    """Building a query's plan runs nothing (the shared tables are written once before)."""
    catalog.engineered(spark, SF)
    tracker = spark.sparkContext.statusTracker()
    for name in ("engineer_features", "generate_forecasts", "sales_box_by_store", "history_summary", "multi_scope_report",
                 "economic_features", "store_features", "latest_per_key"):
        spark.sparkContext.setJobGroup(f"plan-{name}", name)
        catalog.QUERIES[name](spark, SF)
        # opening a Parquet table lists its schema in a job; nothing else may run
        reads = len(tracker.getJobIdsForGroup(f"plan-{name}"))
        assert reads <= _TABLE_READS.get(name, 3), (name, reads)
    spark.sparkContext.setJobGroup("tests", "tests")


def test_date_filter_reaches_the_scan(spark):
    p = _plan(catalog.QUERIES["since_date"](spark, SF))
    assert "PushedFilters: [IsNotNull(feature_date), GreaterThanOrEqual(feature_date" in p
    assert "Exchange" not in p
    assert "ReadSchema: struct<store_id:int,dept_id:int,feature_date:date,weekly_sales:decimal(18,2)>" in p


def test_global_stats_are_broadcast_not_single_partition_windows(spark):
    p = _plan(catalog.QUERIES["zscore_anomalies"](spark, SF))
    assert "BroadcastNestedLoopJoin" in p and "BroadcastExchange" in p
    # the only single-partition step is the final merge of one partial row per task
    assert "Window" not in p


def test_cluster_conf_caps_partitions():
    c = cluster_conf(100 * 2 ** 40, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100_000
    small = cluster_conf(10 * 2 ** 30, 100)
    assert int(small["spark.sql.shuffle.partitions"]) == 300  # at least 3 per core
