"""The driver contract: registration, plans, agreement of names."""

from __future__ import annotations

import re

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_cross_join(spark, sf_dir):
    for name in ("near_duplicate_pairs", "overlap_pairs", "benchmark_contamination", "score_entities", "scope_association", "nearest_pairing", "top_orders", "hard_negatives", "alias_remap"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        if name not in ("near_duplicate_pairs",):
            assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = entry.queries()["pricing_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_partkey" not in plan
    assert "WindowGroupLimit" in entry.queries()["top_orders"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
