"""Plans: what the scans read, and that no query pairs all rows with all rows."""

import pytest

from palimpsest.plans import catalog

#: A single row, a stated query set, or a fixture is on one side of these nested loops.
STATED = {
    "report_metrics", "best_threshold_by_lang", "episode_metrics", "truncation_report", "class_weights", "assign_splits", "split_manifest", "route_by_manifest",
    "label_stats", "bm25_top_k", "cosine_top_k", "phase_summary", "personalised_rank", "distractor_pool",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {n for n in catalog.QUERIES if n.startswith("stream_")}))
def test_no_product(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert name in STATED or "BroadcastNestedLoopJoin" not in text


def test_scans_are_narrow_and_filtered(spark, sf):
    text = plan(catalog.QUERIES["trigger_steps"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    text = plan(catalog.QUERIES["latest_summary_as_of"](spark, sf))
    assert "EqualTo(event_type,purchase)" in text and "EqualTo(event_type,error)" in text
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text


def test_one_shuffle_for_a_window_chain(spark, sf):
    text = plan(catalog.QUERIES["token_growth"](spark, sf))
    assert text.count("Exchange hashpartitioning") == 1
