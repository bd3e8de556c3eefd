"""A/B tests and channel economics on hand-made tables."""

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from subtide.operators import abtest, channel
from subtide.operators.abtest import BASE_PLAN, HIGH_PLAN, Arm
from tests.conftest import rows

SUBSCRIBER = (
    "subid long, plan_type string, account_creation_date date, cancel_before_trial_end boolean, "
    "refund_after_trial_tf boolean, retarget_tf boolean, attribution_technical string, "
    "attribution_survey string"
)


def _subscribers(spark, data):
    return spark.createDataFrame(data, SUBSCRIBER)


@pytest.fixture
def population(spark):
    november, may = date(2019, 11, 5), date(2019, 5, 1)
    data = []
    for i in range(10):  # 6 of 10 base rows in November convert, one has a null refund flag
        refund = None if i == 9 else i < 2
        data.append((i, BASE_PLAN, november, i < 8 or i == 9, refund, i % 2 == 0, "email", None))
    data += [(100 + i, BASE_PLAN, may, True, False, False, "email", None) for i in range(5)]
    data += [(200 + i, HIGH_PLAN, november, i < 3, False, None, "email", None) for i in range(4)]
    data += [(300, "other", november, True, False, False, "email", None)]
    return abtest.arm_population(_subscribers(spark, data))


def test_arm_population(population):
    assert population.columns[-2:] == ["year", "month"]
    assert {r.plan_type for r in population.collect()} == {BASE_PLAN, HIGH_PLAN}


def test_conversion_counts_all_rows_of_an_arm(population):
    arms = {"base": Arm(BASE_PLAN, 2019, (11,)), "high": Arm(HIGH_PLAN), "none": Arm(BASE_PLAN, 1990)}
    assert rows(abtest.conversion_rate(population, arms)) == [
        ("base", 10, 6, 0.6),
        ("high", 4, 3, 0.75),
        ("none", 0, 0, None),
    ]


def test_retargeted_arm_ignores_null(population):
    arm = {"high": Arm(HIGH_PLAN, retargeted=False)}
    assert rows(abtest.conversion_rate(population, arm)) == [("high", 0, 0, None)]


def test_z_and_power(population):
    control, treatment = Arm(BASE_PLAN, 2019, (11,)), Arm(HIGH_PLAN)
    z = abtest.ab_z_test(population, control, treatment).first()
    assert z.z == pytest.approx((0.75 - 0.6) / math.sqrt(0.6 * 0.4 / 4))
    power = abtest.power_table(population, {"high": (control, treatment)}).first()
    mean = (0.75 + 0.6) / 2
    need = 1.96 * math.sqrt(2 * mean * (1 - mean)) + 0.842 * math.sqrt(0.6 * 0.4 + 0.75 * 0.25)
    assert power.required_users == pytest.approx(need**2 / 0.15**2)
    assert power.is_powered is False


def test_equal_rates_have_no_size_and_no_error(population):
    arm = Arm(BASE_PLAN, 2019, (5,))
    assert abtest.ab_z_test(population, arm, arm).first().z is None
    assert abtest.power_table(population, {"x": (arm, arm)}).first().required_users is None


def test_arm_mix_keeps_null_category(spark):
    data = [(1, BASE_PLAN, None, True, False, False, "email", None)] * 3
    data += [(2, BASE_PLAN, None, True, False, False, "facebook", "email")]
    mix = abtest.arm_mix(_subscribers(spark, data), ["attribution_technical", "attribution_survey"])
    assert set(rows(mix)) == {
        (BASE_PLAN, "attribution_technical", "email", 3, 0.75),
        (BASE_PLAN, "attribution_technical", "facebook", 1, 0.25),
        (BASE_PLAN, "attribution_survey", None, 3, 0.75),
        (BASE_PLAN, "attribution_survey", "email", 1, 0.25),
    }


@pytest.fixture
def spend(spark):
    data = [(2019, 6, 5.0, 1.0), (2019, 7, 30.0, 10.0), (2019, 8, 8.0, None), (2019, 10, 1.0, 2.0)]
    return spark.createDataFrame(data, "year int, month int, email double, facebook double")


def test_channel_cac_rules(spark, spend):
    july, august = date(2019, 7, 3), date(2019, 8, 3)
    subscribers = _subscribers(
        spark,
        [
            (1, BASE_PLAN, july, True, False, False, "email", "email"),
            (2, BASE_PLAN, july, False, False, False, "email", "facebook"),
            (3, BASE_PLAN, july, True, None, False, "email", None),
            (4, BASE_PLAN, july, True, True, False, "facebook", "email"),  # nobody pays
            (5, BASE_PLAN, august, True, False, False, "organic", "email"),  # no spend data
            (6, BASE_PLAN, august, True, False, False, None, "email"),
        ],
    )
    long = channel.unpivot_channels(spend)
    table = channel.channel_cac(subscribers, long, channel.spend_channels(spend))
    assert rows(table) == [
        (2019, 10, "email", None, None, 1.0, None, None),
        (2019, 10, "facebook", None, None, 2.0, None, None),
        (2019, 7, "email", 3, 1, 30.0, 10.0, 30.0),
        (2019, 7, "facebook", None, None, 10.0, None, None),
        (2019, 8, "email", None, None, 8.0, None, None),
    ]
    survey = channel.channel_cac(subscribers, long, ["email", "facebook"], "attribution_survey")
    by_key = {(r.month, r.attribution): (r.total_users, r.paying_users) for r in survey.collect()}
    assert by_key[7, "email"] == (2, 1)  # rows chosen by survey, counted by technical channel
    assert by_key[7, "facebook"] == (None, None)
    fixed = channel.channel_cac(
        subscribers, long, ["email", "facebook"], "attribution_survey", "attribution_survey"
    )
    by_key = {(r.month, r.attribution): (r.total_users, r.paying_users) for r in fixed.collect()}
    assert by_key[8, "email"] == (2, 2)


def test_coverage_counts_first_dates(spark):
    cs = spark.createDataFrame(
        [(1, date(2019, 8, 1)), (1, date(2019, 7, 1)), (2, date(2019, 7, 9)), (3, date(2019, 9, 9))],
        "subid long, account_creation_date date",
    )
    sample = cs.where("subid = 1 AND account_creation_date < '2019-08-01'")
    assert rows(channel.coverage_by_month(sample, cs)) == [(2019, 7, 2, 1, 0.5)]


def test_pared_spend_needs_coverage(spark, spend):
    coverage = spark.createDataFrame([(2019, 7, 0.5)], "year int, month int, percent double")
    assert rows(channel.pare_spend(spend, coverage)) == [
        (2019, 7, "email", 15.0),
        (2019, 7, "facebook", 5.0),
    ]


def test_marginal_change_over_new_year_and_gaps(spark):
    data = [
        (2019, 11, "email", 1.0, 10),
        (2019, 12, "email", 4.0, 12),
        (2020, 1, "email", 2.0, 20),
        (2020, 3, "email", 9.0, 30),
        (2020, 1, "facebook", 7.0, 1),
    ]
    table = spark.createDataFrame(
        data, "year int, month int, attribution string, spend double, total_users long"
    )
    found = {(r.year, r.month, r.attribution): r[3:] for r in channel.marginal_change(table).collect()}
    assert found == {
        (2019, 11, "email"): (None, None),
        (2019, 12, "email"): (3.0, 2),
        (2020, 1, "email"): (-2.0, 8),
        (2020, 3, "email"): (None, None),
        (2020, 1, "facebook"): (None, None),
    }


def test_monthly_keys_ignore_null_dates(spark):
    df = _subscribers(spark, [(1, BASE_PLAN, None, True, False, False, "email", None)])
    assert rows(channel.monthly_accounts(df)) == []
    assert channel.user_counts(df, ["email"]).agg(F.sum("users")).first()[0] is None
