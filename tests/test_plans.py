"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from subtide.operators import channel, churn, models, relational, scenario
from subtide.plans import BUILDERS
from subtide.plans.churn_plans import features

MODEL_QUERIES = {
    "fit_tree", "fit_forest", "fit_gbt", "fit_logistic", "fit_ols", "grid_tree", "grid_forest",
    "tree_importances", "forest_importances", "logistic_coefficients", "scored_test", "tree_roc",
    "tree_threshold_report", "model_auc", "model_roc", "model_reports", "clv_of_tree_score",
    "offers_of_tree_score", "ols_optimum", "tree_importance_names", "tree_leaf_means", "fit_tree_rows",
    "scored_test_rows", "tree_roc_shape", "clv_of_tree_score_rows",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _operators(df) -> list[str]:
    return [line.lstrip(" :+-*()0123456789") for line in plan(df).splitlines()]


@pytest.mark.parametrize("name", sorted(set(BUILDERS) - MODEL_QUERIES))
def test_no_python_rows_no_products_no_single_task_windows(name, inputs):
    operators = _operators(BUILDERS[name](inputs))
    text = "\n".join(operators)
    assert "BatchEvalPython" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for i, operator in enumerate(operators):
        if operator.startswith("Window"):
            below = "\n".join(operators[i : i + 4])
            assert "SinglePartition" not in below, below


def test_scans_are_pruned_and_filtered(inputs):
    text = plan(churn.paying_cohort(inputs.customer_service))
    assert "EqualTo(payment_period,1)" in text and "GreaterThan(revenue_net_1month,0.0)" in text
    counts = channel.user_counts(inputs.subscribers, ["email", "search"])
    text = plan(counts)
    assert "In(attribution_technical, [email,search])" in text
    assert "ReadSchema: struct<subid:bigint,account_creation_date:date,attribution_technical:string>" in text


def test_lifetime_value_has_no_shuffle_by_subscriber(inputs):
    text = plan(BUILDERS["clv_with_cac"](inputs.staged()))
    assert text.count("/features-") == 0 and "Exchange hashpartitioning(subid, _salt" not in text


def test_model_rows_are_drawn_and_assembled_once(inputs):
    data = models.prepare(features(inputs))
    for rows in (data.train, data.test):
        text = plan(rows)
        assert "md5" not in text and "UDF" not in text and "is_train" in text.split("PartitionFilters")[1][:60]


def test_feature_table_scans_each_input_once(inputs):
    text = plan(features(inputs))
    assert text.count("FileScan parquet") == 3
    assert text.count("/engagement-") == 1


def test_identity_features_read_one_engagement_column(inputs):
    table = features(inputs).select("subid", "churn")
    scan = next(line for line in plan(table).splitlines() if "/engagement-" in line)
    assert scan.rstrip().endswith("ReadSchema: struct<subid:bigint>")


def test_id_intersection_shuffles_once(inputs):
    ids = relational.id_intersection(inputs.engagement, inputs.subscribers, inputs.customer_service)
    operators = _operators(ids)
    assert sum(o.startswith("Exchange") for o in operators) == 1
    assert not any("Join" in o for o in operators)


def test_dedup_folds_before_the_shuffle(inputs):
    first = relational.dedup_first(inputs.customer_service, "subid", ["account_creation_date"])
    operators = _operators(first)
    exchange = next(i for i, o in enumerate(operators) if o.startswith("Exchange"))
    assert any("partial_min" in o for o in operators[exchange:])


def test_scenarios_do_not_shuffle(inputs):
    scored = inputs.subscribers.selectExpr("subid", "1 AS y_actual", "discount_price AS y_pred")
    for df in (scenario.offer_scenario(scored), scenario.offer_scenario_wide(scored)):
        assert "Exchange" not in plan(df)


def test_lookup_leaves_the_big_side_unshuffled(inputs):
    lookup = inputs.ad_spend.select("year", "month", F.col("email").alias("cost"))
    rows = inputs.subscribers.selectExpr(
        "subid", "year(account_creation_date) AS year", "month(account_creation_date) AS month"
    )
    text = plan(relational.lookup_join(rows, lookup, ["year", "month"], "subid"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
