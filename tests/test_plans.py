"""The physical plans are the intended ones."""

import pytest
from conftest import SF_DIR

from veritrace.plans.catalog import QUERIES


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_conformance_shuffles_once(spark):
    assert plan(spark, "conformance").count("Exchange hashpartitioning") == 1


def test_scan_reads_only_needed_columns_and_filters(spark):
    text = QUERIES["scan_pruned"](spark, SF_DIR)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in text
    assert "GreaterThan(n_chars,500)" in text


@pytest.mark.parametrize("name", [
    "conformance", "token_f1_join", "span_overlaps", "footprint", "running_majority", "group_advantage", "pair_logs",
    "train_test_conformance", "grade_distinct_pairs", "process_reward", "answer_similarity", "run_grid", "variants",
])
def test_no_nested_loop_or_cartesian_product(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
