"""Shapes of physical plans: pushdown, pruning, no Python and no pair products in SQL operators."""
import pytest

from slotworks.plans import catalog

ROOT = "/root/testdata/sf0.001"
PYTHON = {"s06b_import_npz_bank", "s07_read_slices", "m03_ridge_predict", "m05_attention_score", "m06_batch_embed", "m09_train_eval_report"}
LAZY = ["a01_consensus", "a02_source_auc", "a05_auc", "a10_spearman", "a14_intensity_window", "a18_attention_pool", "a19_slot_stats", "a27_report_groups",
        "j02_coverage_report", "j09_merge_rules", "m01_slot_design", "p04_expect_probability", "p10_complete_groups", "w02_select_series", "w03_sample_candidate", "w13_latest_per_key", "w17_consecutive_cosine"]


def plan(spark, name):
    return catalog.QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not any(w in text for w in ("EvalPython", "InPandas", "PythonUDF"))


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(spark, "a04_support")
    assert "text" not in text.split("ReadSchema")[1].split(">")[0]
    text = plan(spark, "p06_restrict_to_ids")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in text and "IsNotNull(user_id)" in text


def test_best_row_operators_shuffle_once_after_a_partial_aggregate(spark):
    from slotworks.operators import selection as SEL
    df = spark.range(10**9).selectExpr("cast(id % 7 as string) study_id", "cast(id % 6 as int) slot", "cast(id as string) series_id", "id % 60 n")
    text = SEL.select_series(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "partial_min" in text and "Window" not in text
