"""Plan regressions: the properties the scale design relies on, read from the executed physical plans."""

import __spark_entry__ as entry
from conftest import SF_MID


def executed_plan(spark, name):
    df = entry.queries()[name](spark, SF_MID)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_tagging_and_filters_are_projections(spark):
    for name in ("tag_logs", "tag_documents", "etl_filter", "model_match_events", "normalize_logs"):
        plan = executed_plan(spark, name)
        assert "Exchange" not in plan and "Join" not in plan, name
        assert "WholeStageCodegen" in plan or "*(" in plan, name


def test_ordered_scans_shuffle_the_rows_once_and_join_nothing(spark):
    """The rows go straight to the partition of their range; bounds and carry are scalar subqueries."""
    for name in ("incidents_instant_accumulated", "logs_to_incidents", "incidents_shared_log_ids",
                 "running_error_count"):
        plan = executed_plan(spark, name)
        assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and "Join" not in plan, name
        rows_part = plan.split("Exchange shufflepartitionidpassthrough")[0]
        assert "Window" in rows_part, name


def test_latest_per_key_is_a_partial_aggregate(spark):
    plan = executed_plan(spark, "latest_event_per_user")
    assert "partial_max_by" in plan and "Window" not in plan


def test_scans_are_pruned_and_filtered(spark):
    plan = executed_plan(spark, "login_attempts_1h")
    assert "PushedFilters: [In(event_type" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    plan = executed_plan(spark, "tag_documents")
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
