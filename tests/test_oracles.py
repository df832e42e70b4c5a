"""Registered queries against DuckDB on the smallest tables (the quick ones; ``tests.compare`` runs all)."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = ["numeric_coercion", "unit_conversion", "formulation_quantities", "formulation_updates", "select_by_date", "daily_log_results",
         "result_analysis", "history_benchmarks", "material_audit", "preflight_summary", "tfidf_search", "work_rerank",
         "evidence_links", "apply_audit", "reagent_reconcile", "next_followup_id", "plan_materialize", "works_read"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    ok, _, _, diff = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert ok, diff


def test_every_query_is_checked():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) - set(entry.LLM_QUERIES) == {"daily_run_summary"}
