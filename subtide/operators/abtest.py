"""A/B tests of pricing plans: conversion, z-scores, power, arm balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions import converted, ratio, with_year_month
from subtide.operators.profile import group_nonnull_counts
from subtide.sources import SUBSCRIBERS, require

# The three plans under test, control first.
BASE_PLAN = "base_uae_14_day_trial"
LOW_PLAN = "low_uae_no_trial"
HIGH_PLAN = "high_uae_14_day_trial"
MAIN_PLANS = (BASE_PLAN, LOW_PLAN, HIGH_PLAN)
# Normal quantiles for 5 % two-sided significance and 80 % power.
T_ALPHA = 1.96
T_BETA = 0.842


@dataclass(frozen=True)
class Arm:
    """Subscribers of one plan, narrowed to months or retargeted ones if given."""

    plan: str
    year: int | None = None
    months: Sequence[int] = ()
    retargeted: bool | None = None

    def predicate(self) -> Column:
        """True for the arm's rows; false, never null, for all others."""
        terms = [F.col("plan_type") == self.plan]
        if self.year is not None:
            terms.append(F.year("account_creation_date") == self.year)
        if self.months:
            terms.append(F.month("account_creation_date").isin(*self.months))
        if self.retargeted is not None:
            terms.append(F.col("retarget_tf") == self.retargeted)
        return F.coalesce(reduce(Column.__and__, terms), F.lit(False))


def arm_population(subscribers: DataFrame, plans: Sequence[str] = MAIN_PLANS) -> DataFrame:
    """Test columns of the subscribers on the given plans, with year and month."""
    columns = [
        "plan_type",
        "account_creation_date",
        "cancel_before_trial_end",
        "refund_after_trial_tf",
        "retarget_tf",
    ]
    require(subscribers, SUBSCRIBERS, columns)
    chosen = subscribers.select(*columns).where(F.col("plan_type").isin(*plans))
    return with_year_month(chosen, "account_creation_date")


def arm_counts(population: DataFrame) -> DataFrame:
    """Non-null counts by year, month, retargeting and plan."""
    return group_nonnull_counts(population, ["year", "month", "retarget_tf", "plan_type"])


def _tally(population: DataFrame, arms: Mapping[str, Arm]) -> DataFrame:
    """One row with ``<arm>_users`` and ``<arm>_converted`` for all arms, in one pass."""
    plans = sorted({arm.plan for arm in arms.values()})
    paying, counts = converted(), []
    for name, arm in arms.items():
        member = arm.predicate()
        counts.append(F.count_if(member).alias(f"{name}_users"))
        counts.append(F.count_if(member & paying).alias(f"{name}_converted"))
    return population.where(F.col("plan_type").isin(*plans)).agg(*counts)


def _rate(name: str) -> Column:
    return ratio(F.col(f"{name}_converted"), F.col(f"{name}_users"))


def conversion_rate(population: DataFrame, arms: Mapping[str, Arm]) -> DataFrame:
    """Users, converted users and conversion rate of each arm.

    Arms may overlap: every arm is a conditional count of the same single pass.
    """
    rows = [
        F.struct(
            F.lit(name).alias("arm"),
            F.col(f"{name}_users").alias("users"),
            F.col(f"{name}_converted").alias("converted"),
            _rate(name).alias("conversion_rate"),
        )
        for name in arms
    ]
    return _tally(population, arms).select(F.inline(F.array(*rows)))


def ab_z_test(population: DataFrame, control: Arm, treatment: Arm) -> DataFrame:
    """z = (p_t - p_c) / sqrt(p_c (1 - p_c) / n_t), as one row.

    The variance is the control's over the treatment's size. Null if it is zero.
    """
    p_c, p_t, n = F.col("control_rate"), F.col("treatment_rate"), F.col("treatment_users")
    tally = _tally(population, {"control": control, "treatment": treatment}).select(
        _rate("control").alias("control_rate"),
        _rate("treatment").alias("treatment_rate"),
        n,
    )
    return tally.withColumn("z", ratio(p_t - p_c, F.sqrt(ratio(p_c * (1 - p_c), n))))


def required_sample_size(
    p0: Column, p1: Column, t_alpha: float = T_ALPHA, t_beta: float = T_BETA
) -> Column:
    """Users an arm needs to tell rate ``p1`` from rate ``p0``; null if they are equal."""
    pooled = (p0 + p1) / 2
    spread = t_alpha * F.sqrt(2 * pooled * (1 - pooled)) + t_beta * F.sqrt(
        p0 * (1 - p0) + p1 * (1 - p1)
    )
    return ratio(spread * spread, (p1 - p0) * (p1 - p0))


def power_table(
    population: DataFrame,
    tests: Mapping[str, tuple[Arm, Arm]],
    t_alpha: float = T_ALPHA,
    t_beta: float = T_BETA,
) -> DataFrame:
    """For each named (control, treatment) test: required size and whether it is met."""
    arms = {}
    for name, (control, treatment) in tests.items():
        arms[f"{name}_control"], arms[f"{name}_treatment"] = control, treatment
    rows = []
    for name in tests:
        p0, p1 = _rate(f"{name}_control"), _rate(f"{name}_treatment")
        users = F.col(f"{name}_treatment_users")
        required = required_sample_size(p0, p1, t_alpha, t_beta)
        rows.append(
            F.struct(
                F.lit(name).alias("test"),
                p0.alias("control_rate"),
                p1.alias("treatment_rate"),
                users.alias("users"),
                required.alias("required_users"),
                (users >= required).alias("is_powered"),
            )
        )
    return _tally(population, arms).select(F.inline(F.array(*rows)))


def arm_means(
    subscribers: DataFrame,
    measures: Mapping[str, Column],
    plans: Sequence[str] = MAIN_PLANS,
) -> DataFrame:
    """Mean of each measure by plan, to look for confounders between arms."""
    return (
        subscribers.where(F.col("plan_type").isin(*plans))
        .groupBy("plan_type")
        .agg(F.count("*").alias("users"), *[F.avg(v).alias(n) for n, v in measures.items()])
    )


def arm_mix(
    subscribers: DataFrame,
    covariates: Sequence[str],
    plans: Sequence[str] = MAIN_PLANS,
) -> DataFrame:
    """Share of each category of each covariate within a plan; null is a category.

    All covariates are counted in one pass. The totals come from the counts,
    which are as small as the number of categories.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("covariate"), F.col(c).alias("category")) for c in covariates]
    )
    counts = (
        subscribers.where(F.col("plan_type").isin(*plans))
        .select("plan_type", F.inline(cells))
        .groupBy("plan_type", "covariate", "category")
        .agg(F.count("*").alias("users"))
    )
    totals = counts.groupBy("plan_type", "covariate").agg(F.sum("users").alias("_total"))
    return counts.join(totals, ["plan_type", "covariate"]).select(
        "plan_type",
        "covariate",
        "category",
        "users",
        ratio(F.col("users"), F.col("_total")).alias("share"),
    )
