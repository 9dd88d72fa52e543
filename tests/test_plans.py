"""The shape of the physical plans."""

from __future__ import annotations

import pytest
from helpers import SMALL

from spillway.catalog import QUERIES
from spillway.catalog.reports import REPORTS
from spillway import plans
from spillway.sources import loan_book_from_orders, read_parquet_book, write_parquet_book

#: Queries that have done their work before they return a frame to read.
EAGER = {
    "approval_calibration", "approval_evaluation", "approval_probability", "live_approval_alerts",
    "live_click_funnel", "live_click_sessions", "live_loan_days", "live_loan_funnel",
    "standing_channel_performance", "standing_executive_dashboard", "standing_segment_conversion",
}


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The loan book as Parquet tables, the way a job on a cluster reads it."""
    place = str(tmp_path_factory.mktemp("book"))
    write_parquet_book(loan_book_from_orders(spark, SMALL), place)
    return read_parquet_book(spark, place)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_python_and_no_products(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_global_windows_and_limits_only_see_aggregates(spark, name):
    """A single-partition exchange takes partial aggregates or finished groups, never detail."""
    plan = physical(REPORTS[name](spark, SMALL)).splitlines()
    for i, line in enumerate(plan):
        if "Exchange SinglePartition" in line:
            rest = "\n".join(plan[i + 1 :])
            until_scan = rest[: rest.index("FileScan")]
            assert "HashAggregate" in until_scan, name


def test_one_shuffle_of_the_log(stored):
    """The log is shuffled once; the second exchange carries one row per task."""
    plan = physical(plans.funnel_summary(stored))
    assert plan.count("Exchange") == 2
    assert "hashpartitioning(application_id" in plan and "SinglePartition" in plan
    assert "Expand" not in plan


def test_columns_and_filters_reach_the_scan(stored):
    plan = physical(plans.funnel_overview(stored))
    assert "ReadSchema: struct<application_id:bigint,stage:string>" in plan
    plan = physical(plans.monthly_trend_by_date(stored, 1997))
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(event_timestamp,1997-01-01" in pushed
    assert "In(stage, [disbursed,submitted])" in pushed
    plan = physical(plans.executive_dashboard(stored))
    assert "ReadSchema: struct<application_id:bigint,loan_amount:bigint>" in plan


def test_shared_parts_are_shuffled_once(spark, stored):
    for frame in (plans.monthly_trend(stored, 1997), plans.journey_durations(stored)):
        frame.collect()
        assert "ReusedExchange" in physical(frame)


def test_first_row_per_application_is_taken_before_the_shuffle(spark):
    plan = physical(QUERIES["filter_row_number"](spark, SMALL))
    assert plan.index("Exchange hashpartitioning(application_id") < plan.rindex("WindowGroupLimit")


def test_bucketed_tables_need_no_shuffle_by_application(spark, stored):
    from spillway.sources import read_table_book, write_bucketed_book

    spark.sql("CREATE DATABASE IF NOT EXISTS lending")
    write_bucketed_book(stored, "lending", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = read_table_book(spark, "lending")
        frame = plans.conv_by_loan_type(tables)
        assert "hashpartitioning(application_id" not in physical(frame)
        assert frame.collect() == plans.conv_by_loan_type(stored).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.sql("DROP DATABASE lending CASCADE")


@pytest.mark.parametrize("name", ["vw_channel_performance", "vw_executive_dashboard", "read_all_views", "join_four_tables"])
def test_people_are_never_broadcast(spark, name):
    """However small their files look: the plan before any shuffle has merge joins only."""
    plan = physical(QUERIES[name](spark, SMALL))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
