"""Tables stored in buckets by subscriber: same rows, no shuffle when they are used, nothing left behind."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from subtide.operators import churn, encode
from subtide.plans.churn_plans import FEATURE_COLUMNS, features
from subtide.sources import release, scope, shared_folder, store_by_key
from tests.conftest import rows


@pytest.fixture(scope="module")
def store(inputs):
    return churn.subscriber_store(inputs.subscribers, inputs.customer_service, inputs.engagement)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_uses_of_the_store_do_not_shuffle(store, no_broadcast):
    assert store.hot is None
    for table in (store.features(), store.features(2), encode.with_split(store.features(None))):
        assert "SortMergeJoin" in plan(table) and "Exchange" not in plan(table)
        assert "SelectedBucketsCount: 4 out of 4" in plan(table)
    folded = store.features(None).groupBy("subid").agg(F.sum("churn"))
    assert "Exchange" not in plan(folded)


def test_the_plain_form_does_shuffle(inputs, no_broadcast):
    assert "Exchange hashpartitioning(subid" in plan(features(inputs))


def test_same_features_as_without_a_store(inputs, store):
    for period in (0, 1, 2):
        want = churn.churn_feature_table(inputs.subscribers, inputs.customer_service, inputs.engagement, period=period)
        assert rows(store.features(period).select(FEATURE_COLUMNS)) == rows(want.select(FEATURE_COLUMNS))
    assert store.features(None).count() == sum(store.features(p).count() for p in (0, 1, 2))


def test_hot_subscribers_are_kept_apart(inputs):
    """One subscriber with a third of all rows; null subscribers are in no table."""
    paid = inputs.customer_service.where("payment_period = 1 AND trial_completed_tf AND revenue_net_1month > 0")
    ids = features(inputs).orderBy("subid").select("subid").limit(1)
    one = paid.join(ids, "subid").select(paid.columns)
    many = one.crossJoin(inputs.spark.range(paid.count() // 2)).select(paid.columns)
    nobody = paid.limit(5).withColumn("subid", F.lit(None).cast("bigint"))
    cs = inputs.customer_service.unionByName(many).unionByName(nobody)
    hot = ids.first()["subid"]
    found = churn.subscriber_store(inputs.subscribers, cs, inputs.engagement, share=0.1)
    assert {r["subid"] for r in found.hot.select("subid").distinct().collect()} == {hot}
    assert found.rows.where(F.col("subid") == hot).isEmpty() and found.rows.where("subid IS NULL").isEmpty()
    want = churn.churn_feature_table(inputs.subscribers, cs, inputs.engagement)
    assert rows(found.features().select(FEATURE_COLUMNS)) == rows(want.select(FEATURE_COLUMNS))


def test_empty_tables(inputs):
    empty = inputs.customer_service.limit(0)
    assert churn.subscriber_store(inputs.subscribers, empty, inputs.engagement).features().isEmpty()
    none = inputs.engagement.limit(0)
    assert churn.subscriber_store(inputs.subscribers, inputs.customer_service, none).features().isEmpty()


def test_nothing_is_left_of_released_stores(spark):
    folder = f"{shared_folder(spark)}/subtide"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    tables = {t.name for t in spark.catalog.listTables()}
    kept = store_by_key(spark.range(100), "numbers", ["id"], buckets=3)
    assert kept.count() == 100 and len(kept.inputFiles()) == 3
    release(kept)
    with pytest.raises(RuntimeError), scope(spark):
        store_by_key(spark.range(10), "numbers", ["id"])
        raise RuntimeError
    assert set(os.listdir(folder)) == before
    assert {t.name for t in spark.catalog.listTables()} == tables
