"""Registered queries against their oracle SQL on the smallest tables.

By default one query per operator group of each family runs; RUNLENS_ALL=1 runs them all.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import check, connection

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
QUICK = [
    "f0_bucket_spine", "f3_cost_by_model", "f5_new_users", "f10_average_user_cost", "f12_runs_by_tag", "f14_latency_percentiles", "f17_feedback_ratio", "f22_zero_filled",
    "d0_nested_members", "d10_type_trace", "d15_metadata", "d18_pii", "d22_intents", "d25_feedback_none", "d5_check_runner", "e4_parent_feedback", "e5_child_feedbacks_array",
    "g2_top_models_of_org", "g4_top_agents", "g9_usage_limit_flag", "h2_neighbours", "h3_item_numbering", "j7_intents", "k1_descendants", "k2_root_of_run", "k7_thread_transcript",
    "a1_event_source", "a3_spans_to_events", "a5_attribute_mapping", "a8_tool_call_rollup", "b12_user_cascade", "b13_run_fold", "b16_feedback_merge", "b19_chat_runs", "b23_redaction", "b24_event_report",
    "c2_run_cost", "c3_legacy_price", "c5_recost_as_of", "l11_template_rendering", "m1_bleu", "m5_term_cosine", "n3_language_detection", "n8_intent_transcript_tail", "o6_alias_mapping",
    "p1_snapshot_version", "p8_run_summary", "qa_error_rate_window", "qe_alert_transitions", "qh_retention_redact", "stream_b13_run_fold", "stream_b19_chat",
]
NAMES = sorted(QUERIES) if os.environ.get("RUNLENS_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    rows, problem = check(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "value", "name"] and df.limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
