"""Plan-level checks of the scale rules (plans only; nothing large is executed)."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

# queries whose callables run actions (checkpoints, writes, streams); their plans are checked elsewhere
ACTIONS = {"assign_mechanics", "append_report", "append_audit_log", "refresh_stats_table", "activity_log_stream",
           "load_tables_roundtrip", "append_report_empty_period", "apply_task_status", "apply_new_bookings", "provision_users", "moderate_testimonials",
           "testimonial_reject_classes"} | {n for n in E.queries() if "_after_" in n or n.startswith("op") or n in (
               "pipeline", "apply_new_vehicles", "apply_messages", "booking_document", "mechanic_document", "service_document",
               "vehicle_document", "task_document", "related_documents", "mechanic_daily_tasks")}


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - ACTIONS))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name,column", [("revenue_by_month", "booking_date"), ("bookings_by_status", "booking_date"),
                                          ("booking_report_detail", "booking_date"), ("todays_bookings", "booking_date")])
def test_date_filters_reach_the_scan(spark, name, column):
    plan = _plan(spark, name)
    pushed = re.findall(r"PushedFilters: \[(.*)\]", plan)
    assert any(column in p and ("GreaterThanOrEqual" in p or "EqualTo" in p) for p in pushed), pushed


def test_projection_pruned(spark):
    plan = _plan(spark, "bookings_by_status")
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan)
    assert schemas == ["booking_date:date,status:string"], schemas


@pytest.mark.parametrize("name", ["schedule_conflicts", "available_time_slots", "within_availability"])
def test_interval_operators_do_not_pair_bookings(spark, name):
    """No join whose keys are only (mechanic_id, booking_date): that would pair every booking of a day."""
    plan = _plan(spark, name)
    for keys in re.findall(r"Left keys \[\d+\]: \[(.*?)\]", plan):
        names = sorted(re.sub(r"#\d+L?", "", k).strip() for k in keys.split(","))
        assert names != ["booking_date", "mechanic_id"], (name, keys)


@pytest.mark.parametrize("name,table,n", [("generate_report", "bookings", 1), ("within_availability", "bookings", 1),
                                           ("related_bookings", "bookings", 2), ("related_bookings", "services", 1)])
def test_tables_are_scanned_no_more_than_needed(spark, name, table, n):
    """The report's range once, availability once, groups and their members once each, services once."""
    assert len(re.findall(rf"Location: .*?/{table}\]", _plan(spark, name))) == n
