"""Offer scenarios, acquisition cost and lifetime value."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from subtide.functions import threshold_tag, u01
from subtide.operators import clv, scenario
from tests.conftest import rows


@pytest.fixture
def scored(spark):
    return spark.range(4000).select(
        F.col("id").alias("subid"),
        (F.col("id") % 2).cast("int").alias("y_actual"),
        F.round(u01("id", "p"), 2).alias("y_pred"),
    )


def test_tags():
    assert [threshold_tag(t) for t in (0.5, 0.55, 1.0)] == ["0_5", "0_55", "1"]


def test_each_row_has_one_plan_for_each_threshold(scored):
    long = scenario.offer_scenario(scored)
    assert rows(long.groupBy("threshold").count()) == [(0.3, 4000), (0.5, 4000), (0.7, 4000)]
    for r in long.collect():
        assert r.get_offer == int(r.y_pred >= r.threshold)
        assert r.accept_offer <= r.get_offer
        assert r.renew_at_base == int(r.y_actual == 0 and not r.accept_offer)
        assert r.plan == ("offer" if r.accept_offer else "base" if r.renew_at_base else "churn")


def test_accept_rate_is_the_argument(scored):
    for rate in (0.0, 0.3, 1.0):
        offers = scenario.offer_scenario(scored, [0.5], rate).where("get_offer = 1")
        assert offers.agg(F.avg("accept_offer")).first()[0] == pytest.approx(rate, abs=0.04)


def test_wide_form_holds_the_long_form(scored):
    wide = scenario.offer_scenario_wide(scored)
    assert wide.columns[3:7] == ["get_offer_0_5", "accept_offer_0_5", "renew_at_base_0_5", "plan_0_5"]
    long = scenario.offer_scenario(scored, [0.7]).drop("threshold")
    names = ["subid", "y_actual", "y_pred", "get_offer_0_7", "accept_offer_0_7", "renew_at_base_0_7", "plan_0_7"]
    assert rows(wide.select(*names)) == rows(long)


def test_counts(scored):
    wide = scenario.offer_scenario_wide(scored, [0.5])
    plans = scenario.plan_counts(wide, 0.5).collect()
    assert sum(r.subid for r in plans) == 4000 and {r.plan_0_5 for r in plans} == {"offer", "base", "churn"}
    assert {(r.y_actual, r.subid) for r in scenario.actual_counts(wide).collect()} == {(0, 2000), (1, 2000)}


@pytest.fixture
def customers(spark):
    channels = ["email", "organic", "affiliate", None, "pininterest_organic", "facebook_organic"]
    data = [(i, date(2019, 7, 1), c, 5.0, 2.0, None if i else 1.5) for i, c in enumerate(channels)]
    table = spark.createDataFrame(
        data,
        "subid long, account_creation_date date, attribution_technical string, "
        "monthly_price double, discount_price double, join_fee double",
    )
    return table.selectExpr("*", "year(account_creation_date) AS year", "month(account_creation_date) AS month")


@pytest.fixture
def channel_table(spark):
    return spark.createDataFrame(
        [(2019, 7, "email", 3.0), (2019, 8, "email", 9.0), (2019, 7, "search", None)],
        "year int, month int, attribution string, cac double",
    )


def test_subscriber_cac(customers, channel_table):
    filled = clv.subscriber_cac(customers, channel_table)
    assert {r.subid: r.cac_filled for r in filled.collect()} == {
        0: 3.0, 1: 0.0, 2: 5.521, 3: 5.521, 4: 0.0, 5: 0.0
    }
    assert {r.join_fee for r in filled.collect()} == {1.5, 0.0}
    mean = clv.subscriber_cac(customers, channel_table, default_cac=None)
    assert {r.subid: r.cac_filled for r in mean.collect()}[2] == 6.0
    assert clv.mean_cac(channel_table).first()[0] == 6.0


def scored_customers(spark, customers, scores):
    """The customers' cost columns with their scores; a subid may have several."""
    scored = spark.createDataFrame(scores, "subid long, y_actual int, y_pred double")
    return scored.join(customers.select("subid", *clv.COST_COLUMNS), "subid", "left")


def test_clv_formula(spark, customers, channel_table):
    scored = scored_customers(spark, customers, [(0, 1, 0.4), (99, 0, 0.1)])
    costed = clv.with_costs(scored, channel_table)
    value = {r.subid: r.clv_with_cac for r in clv.clv(costed).collect()}
    assert value[0] == pytest.approx(2.0 * 4 * 1.03 / (1.03 - 0.6) + 2.0 * 4 + 1.5 - 3.0)
    assert value[99] is None
    without = {r.subid: r.clv_without_cac for r in clv.clv(costed, with_cac=False).collect()}
    assert without[0] == pytest.approx(value[0] + 3.0)


def test_clv_falls_with_churn_and_survives_zero_divisor(spark, customers, channel_table):
    scored = scored_customers(spark, customers, [(0, 0, p / 10) for p in range(11)])
    costed = clv.with_costs(scored, channel_table)
    found = clv.clv(costed).orderBy("y_pred").collect()
    assert len(found) == 11  # as many rows of a subid as went in
    values = [r.clv_with_cac for r in found]
    assert values == sorted(values, reverse=True)
    assert clv.clv(costed, discount_rate=0.0).where("y_pred = 0").first().clv_with_cac is None


def test_unknown_numbers_cost_what_nulls_cost(spark, customers, channel_table):
    nan = customers.withColumn("join_fee", F.lit(float("nan")))
    assert {r.join_fee for r in clv.subscriber_cac(nan, channel_table).collect()} == {0.0}


def test_near_thresholds_have_columns_and_draws_of_their_own(scored):
    wide = scenario.offer_scenario_wide(scored, [0.1234567, 0.1234568], 0.5)
    assert {"accept_offer_0_1234567", "accept_offer_0_1234568"} <= set(wide.columns)
    assert not wide.where("accept_offer_0_1234567 <> accept_offer_0_1234568").isEmpty()
