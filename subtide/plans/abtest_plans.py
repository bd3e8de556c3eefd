"""Queries of the A/B tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.operators import abtest
from subtide.operators.abtest import BASE_PLAN, HIGH_PLAN, LOW_PLAN, Arm
from subtide.plans.inputs import Inputs
from subtide.plans.registry import query

YEAR = 1998
ARMS = {
    "base_november": Arm(BASE_PLAN, YEAR, (11,)),
    "base_window": Arm(BASE_PLAN, YEAR, (7, 8, 9, 10, 11)),
    "base_window_retargeted": Arm(BASE_PLAN, YEAR, (7, 8, 9, 10, 11), retargeted=True),
    "high": Arm(HIGH_PLAN),
    "low": Arm(LOW_PLAN),
}

_BASE = "plan_type = 'base_uae_14_day_trial'"
_WINDOW = f"{_BASE} AND year = {YEAR} AND month IN (7, 8, 9, 10, 11)"
_WHERE = {
    "base_november": f"{_BASE} AND year = {YEAR} AND month = 11",
    "base_window": _WINDOW,
    "base_window_retargeted": f"{_WINDOW} AND retarget_tf",
    "high": "plan_type = 'high_uae_14_day_trial'",
    "low": "plan_type = 'low_uae_no_trial'",
}


def _rate(arm: str) -> str:
    return (
        f"(SELECT CAST(count(*) FILTER (paying) AS DOUBLE) / count(*) FROM pay_flags WHERE {_WHERE[arm]})"
    )


def _size(arm: str) -> str:
    return f"(SELECT count(*) FROM pay_flags WHERE {_WHERE[arm]})"


def _z_sql(control: str, treatment: str) -> str:
    return (
        "SELECT control_rate, treatment_rate, treatment_users, (treatment_rate - control_rate) / "
        "nullif(sqrt(control_rate * (1 - control_rate) / treatment_users), 0) AS z FROM (SELECT "
        f"{_rate(control)} AS control_rate, {_rate(treatment)} AS treatment_rate, "
        f"{_size(treatment)} AS treatment_users)"
    )


def _power_sql(tests: dict[str, tuple[str, str]]) -> str:
    rates = " UNION ALL ".join(
        f"SELECT '{name}' AS test, {_rate(c)} AS p0, {_rate(t)} AS p1, {_size(t)} AS users"
        for name, (c, t) in tests.items()
    )
    return (
        "SELECT test, p0 AS control_rate, p1 AS treatment_rate, users, "
        "round(need, 6) AS required_users, users >= need AS is_powered FROM ("
        "SELECT *, pow(1.96 * sqrt(2 * (p0 + p1) / 2 * (1 - (p0 + p1) / 2)) "
        "+ 0.842 * sqrt(p0 * (1 - p0) + p1 * (1 - p1)), 2) / pow(p1 - p0, 2) AS need "
        f"FROM ({rates}))"
    )


@query(
    "ab_arm_counts",
    "SELECT year, month, retarget_tf, plan_type, count(account_creation_date) AS account_creation_date, "
    "count(cancel_before_trial_end) AS cancel_before_trial_end, "
    "count(refund_after_trial_tf) AS refund_after_trial_tf FROM pay_flags "
    "WHERE plan_type IN ('base_uae_14_day_trial', 'low_uae_no_trial', 'high_uae_14_day_trial') "
    "GROUP BY year, month, retarget_tf, plan_type",
)
def ab_arm_counts(t: Inputs) -> DataFrame:
    return abtest.arm_counts(abtest.arm_population(t.subscribers))


@query(
    "ab_conversion",
    " UNION ALL ".join(
        f"SELECT '{arm}' AS arm, count(*) AS users, count(*) FILTER (paying) AS converted, "
        f"CAST(count(*) FILTER (paying) AS DOUBLE) / count(*) AS conversion_rate "
        f"FROM pay_flags WHERE {where}"
        for arm, where in _WHERE.items()
    ),
)
def ab_conversion(t: Inputs) -> DataFrame:
    return abtest.conversion_rate(abtest.arm_population(t.subscribers), ARMS)


def _z_test(t: Inputs, control: str, treatment: str) -> DataFrame:
    population = abtest.arm_population(t.subscribers)
    return abtest.ab_z_test(population, ARMS[control], ARMS[treatment])


@query("ab_z_high", _z_sql("base_november", "high"))
def ab_z_high(t: Inputs) -> DataFrame:
    return _z_test(t, "base_november", "high")


@query("ab_z_low", _z_sql("base_window", "low"))
def ab_z_low(t: Inputs) -> DataFrame:
    return _z_test(t, "base_window", "low")


@query("ab_z_low_retargeted", _z_sql("base_window_retargeted", "low"))
def ab_z_low_retargeted(t: Inputs) -> DataFrame:
    return _z_test(t, "base_window_retargeted", "low")


# Each test against its own control, and both against the retargeted base rate.
OWN_CONTROL = {"high": ("base_november", "high"), "low": ("base_window", "low")}
LAST_CONTROL = {
    "high": ("base_window_retargeted", "high"),
    "low": ("base_window_retargeted", "low"),
}


def _power(t: Inputs, tests: dict[str, tuple[str, str]]) -> DataFrame:
    arms = {name: (ARMS[c], ARMS[x]) for name, (c, x) in tests.items()}
    table = abtest.power_table(abtest.arm_population(t.subscribers), arms)
    return table.withColumn("required_users", F.round("required_users", 6))


@query("ab_power", _power_sql(OWN_CONTROL))
def ab_power(t: Inputs) -> DataFrame:
    return _power(t, OWN_CONTROL)


@query("ab_power_retargeted", _power_sql(LAST_CONTROL))
def ab_power_retargeted(t: Inputs) -> DataFrame:
    return _power(t, LAST_CONTROL)


@query(
    "ab_arm_balance",
    "SELECT plan_type, count(*) AS users, round(avg(CAST(male_tf AS DOUBLE)), 8) AS male_share, "
    "round(avg(CAST(retarget_tf AS DOUBLE)), 8) AS retargeted_share, "
    "round(avg(CAST(package_type IS NULL AS DOUBLE)), 8) AS no_package_share, "
    "round(avg(monthly_price), 8) AS mean_monthly_price, round(avg(join_fee), 8) AS mean_join_fee "
    "FROM subscribers "
    "WHERE plan_type IN ('base_uae_14_day_trial', 'low_uae_no_trial', 'high_uae_14_day_trial') "
    "GROUP BY plan_type",
)
def ab_arm_balance(t: Inputs) -> DataFrame:
    measures = {
        "male_share": F.col("male_tf").cast("double"),
        "retargeted_share": F.col("retarget_tf").cast("double"),
        "no_package_share": F.col("package_type").isNull().cast("double"),
        "mean_monthly_price": F.col("monthly_price"),
        "mean_join_fee": F.col("join_fee"),
    }
    means = abtest.arm_means(t.subscribers, measures)
    return means.select("plan_type", "users", *[F.round(m, 8).alias(m) for m in measures])


@query(
    "ab_arm_mix",
    " UNION ALL ".join(
        f"SELECT plan_type, '{c}' AS covariate, {c} AS category, count(*) AS users, "
        f"CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY plan_type) AS share "
        f"FROM subscribers "
        f"WHERE plan_type IN ('base_uae_14_day_trial', 'low_uae_no_trial', 'high_uae_14_day_trial') "
        f"GROUP BY plan_type, {c}"
        for c in ("attribution_technical", "intended_use", "package_type")
    ),
)
def ab_arm_mix(t: Inputs) -> DataFrame:
    covariates = ["attribution_technical", "intended_use", "package_type"]
    return abtest.arm_mix(t.subscribers, covariates)
