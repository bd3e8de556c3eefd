"""Label, cohort, engagement features, imputation and model inputs."""

from __future__ import annotations

from datetime import date
from itertools import product

import pytest
from pyspark.sql import functions as F

from subtide.functions import days_between, pick, u01
from subtide.operators import churn, encode, relational
from subtide.plans.churn_plans import FEATURE_COLUMNS, features
from tests.conftest import rows


def test_label_of_every_combination(spark):
    states = (None, False, True)
    cases = list(product(states, states, (None, -1.0, 0.0, 1.0)))
    cs = spark.createDataFrame(cases, "renew boolean, current_sub_tf boolean, revenue_net_1month double")
    for r in churn.with_churn_label(cs).collect():
        left = r.renew is False or r.current_sub_tf is False
        refunded = r.revenue_net_1month is not None and r.revenue_net_1month <= 0
        assert r.churn == int(left or refunded), r


def test_paying_cohort_filters(spark):
    day = date(2020, 1, 1)
    data = [
        (1, day, 1, True, True, True, 5.0),
        (2, day, 1, None, True, None, 5.0),
        (3, day, 1, None, True, True, None),
        (4, day, 1, None, True, True, 0.0),
        (5, day, 2, None, True, True, 5.0),
        (6, day, 1, False, True, True, 5.0),
    ]
    cs = spark.createDataFrame(
        data,
        "subid long, account_creation_date date, payment_period int, renew boolean, "
        "current_sub_tf boolean, trial_completed_tf boolean, revenue_net_1month double",
    )
    assert [(r.subid, r.churn) for r in churn.paying_cohort(cs).orderBy("subid").collect()] == [(1, 0), (6, 1)]
    ids = spark.createDataFrame([(6,), (9,)], "subid long")
    assert [r.subid for r in churn.paying_cohort(cs, ids).collect()] == [6]


ENGAGEMENT = "subid long, date date, payment_period int, " + ", ".join(
    f"{m} double" for m in churn.MEASURES
)


def _use(subid, day, period, value):
    return (subid, day, period, *[value] * len(churn.MEASURES))


@pytest.fixture
def engagement(spark):
    data = [
        _use(1, date(2020, 1, 1), 0, 2.0),
        _use(1, date(2020, 1, 2), 0, 3.0),
        _use(1, date(2020, 1, 10), 1, 6.0),
        _use(1, date(2020, 1, 13), 2, 9.0),
        _use(2, date(2020, 1, 10), 1, 4.0),  # a single day
        _use(2, date(2020, 1, 10), 1, None),
        _use(3, date(2020, 1, 10), 0, None),  # known, but never with a complete row
    ]
    return spark.createDataFrame(data, ENGAGEMENT)


def test_engagement_features(engagement):
    n = len(churn.MEASURES)
    assert rows(churn.trial_engagement(engagement)) == [(1, *[5.0] * n)]
    assert rows(churn.daily_engagement(engagement)) == [(1, *[5.0] * n), (2, *[4.0] * n)]
    assert rows(churn.engagement_features(engagement)) == [
        (1, *[5.0] * 2 * n),
        (2, *[0.0] * n, *[4.0] * n),
        (3, *[0.0] * 2 * n),
    ]
    ids = engagement.where("subid = 2")
    assert rows(churn.daily_engagement(engagement, ids=ids)) == [(2, *[4.0] * n)]
    assert rows(churn.trial_engagement(engagement, ids=ids)) == []


def test_days_of_timestamps_round_down(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2020-01-01 20:00:00' AS a, TIMESTAMP_NTZ '2020-01-03 19:00:00' AS b")
    assert df.select(days_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_feature_table_equals_step_by_step_joins(inputs):
    """The one-scan table holds what the separate steps, joined, hold."""
    ids = relational.id_intersection(inputs.engagement, inputs.subscribers, inputs.customer_service)
    steps = (
        churn.paying_cohort(inputs.customer_service, ids)
        .drop("renew", "revenue_net_1month")
        .join(churn.trial_engagement(inputs.engagement, ids=ids), "subid", "left")
        .join(churn.daily_engagement(inputs.engagement, ids=ids), "subid", "left")
        .na.fill(0)
        .join(inputs.subscribers.drop("account_creation_date"), "subid", "left")
        .where("refund_after_trial_tf = false")
        .where(F.col("plan_type").isin(*churn.MAIN_PLANS))
    )
    table = features(inputs)
    assert table.columns == FEATURE_COLUMNS
    numbers = [c for c in table.columns if c.endswith(("_trial", "_daily", "price"))]
    keys = ["subid", "account_creation_date", "churn", *numbers]
    assert rows(table.select(*keys)) == rows(steps.select(*keys))


def test_imputation(spark):
    df = spark.range(20000).selectExpr("id AS subid", "IF(id % 2 = 0, NULL, 'kept') AS preferred_genre")
    filled = churn.impute_categorical(df, "preferred_genre", churn.GENRE_SHARES)
    counts = {r[0]: r[1] / 10000 for r in filled.groupBy("preferred_genre").count().collect()}
    assert counts.pop("kept") == 1.0
    assert counts == pytest.approx(churn.GENRE_SHARES, abs=0.02)
    again = churn.impute_categorical(df.repartition(7), "preferred_genre", churn.GENRE_SHARES)
    assert filled.exceptAll(again).isEmpty()


def test_imputation_from_observed_shares(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "subid long, c string")
    assert churn.observed_shares(df, "c") == {"a": 2 / 3, "b": 1 / 3}
    assert churn.impute_categorical(df, "c").where("c IS NULL").isEmpty()


def test_pick_follows_the_edges(spark):
    draws = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.999,)], "u double")
    chosen = draws.select("u", pick(F.col("u"), ["x", "y", "z"], [0.25, 0.25, 0.5]))
    assert rows(chosen) == [(0.0, "x"), (0.25, "y"), (0.5, "z"), (0.999, "z")]
    with pytest.raises(ValueError, match="sum to 1"):
        pick(F.col("u"), ["x"], [0.5])


def test_draws_are_uniform(spark):
    stats = spark.range(50000).select(u01("id", "s").alias("u")).agg(
        F.min("u"), F.max("u"), F.avg("u"), F.stddev("u")
    ).first()
    assert 0 <= stats[0] and stats[1] < 1
    assert stats[2] == pytest.approx(0.5, abs=0.01) and stats[3] == pytest.approx(12**-0.5, abs=0.01)


def test_dummies_drop_first_level_and_zero_nulls(spark):
    df = spark.createDataFrame(
        [(1, "b x", True), (2, "a", False), (3, None, None), (4, "c", True)],
        "subid long, kind string, flag boolean",
    )
    coded = encode.dummy_encode(df, ["kind", "flag"])
    assert coded.columns == ["subid", "kind_b_x", "kind_c", "flag_true"]
    assert rows(coded) == [(1, 1, 0, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 1, 1)]
    fixed = encode.dummy_encode(df, ["kind"], levels={"kind": ["a", "c"]})
    assert fixed.columns == ["subid", "flag", "kind_c"]


def test_dummy_names_of_many_and_odd_levels(spark):
    df = spark.createDataFrame([("a b",), ("a_b",), ("0",), ("Ä",), ("ä",), ("да",)], "kind string")
    coded = encode.dummy_encode(df, ["kind"])
    assert coded.columns == ["kind_a_b_1", "kind_a_b_2", "kind_ä_3", "kind_ä_4", "kind_да"]
    assert sorted(sum(r) for r in coded.collect()) == [0, 1, 1, 1, 1, 1]
    many = spark.range(300).selectExpr("concat('level', id) AS kind")
    assert len(encode.dummy_encode(many, ["kind"]).columns) == 299
    assert len(churn.observed_shares(many, "kind")) == 300


def test_nan_is_unknown_in_all_engagement_features(spark):
    nan = float("nan")
    data = [(1, date(2019, 7, 1), 0, 1.0), (1, date(2019, 7, 2), 0, nan), (1, date(2019, 8, 1), 1, nan)]
    df = spark.createDataFrame(data, "subid long, date date, payment_period int, app_opens double")
    df = df.withColumns({m: F.lit(2.0) for m in churn.MEASURES[1:]}).withColumn("odd name", F.lit(1))
    both = churn.engagement_features(df).first()
    trial = churn.trial_engagement(df).first()
    assert both.app_opens_trial == trial.app_opens_trial == 1.0
    assert both.num_videos_rated_trial == trial.num_videos_rated_trial == 2.0
    assert both.app_opens_sum_daily == 0.0 and churn.daily_engagement(df).isEmpty()


def test_limits_of_encoding(spark):
    df = spark.createDataFrame([("a",)], "kind string")
    with pytest.raises(ValueError, match="neither text nor flag"):
        encode.category_levels(df.withColumn("n", F.lit(1)), ["n"])


def test_split_is_stable_and_near_its_share(spark):
    df = spark.range(20000).withColumnRenamed("id", "subid")
    train, test = encode.train_test_split(df)
    assert train.count() / 20000 == pytest.approx(0.7, abs=0.02)
    assert train.count() + test.count() == 20000
    again, _ = encode.train_test_split(df.repartition(9))
    assert train.exceptAll(again).isEmpty()


def test_feature_columns_keep_the_discount_price():
    class Table:
        columns = ["subid", "churn", "monthly_price", "discount_price", "app_opens_trial"]

    assert encode.feature_columns(Table) == ["discount_price", "app_opens_trial"]
