"""Retention-offer scenarios over scored subscribers (subid, y_actual, y_pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions import threshold_tag, u01
from subtide.operators.profile import group_nonnull_counts

# The scenario's thresholds and the share that accepts an offer.
THRESHOLDS = (0.5, 0.3, 0.7)
ACCEPT_RATE = 0.3


def _outcome(threshold: float, accept_rate: float, key: str) -> dict[str, Column]:
    """Offer, acceptance, base renewal and plan of a row at one threshold."""
    offered = F.coalesce(F.col("y_pred") >= F.lit(threshold), F.lit(False))
    accepted = offered & (u01(key, f"accept{repr(float(threshold)).removesuffix('.0')}") <= F.lit(accept_rate))
    at_base = (F.col("y_actual") == 0) & ~accepted
    plan = F.when(accepted, "offer").when(at_base, "base").otherwise("churn")
    flags = {"get_offer": offered, "accept_offer": accepted, "renew_at_base": at_base}
    return {**{name: F.when(v, 1).otherwise(0) for name, v in flags.items()}, "plan": plan}


def offer_scenario(
    scored: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    accept_rate: float = ACCEPT_RATE,
    key: str = "subid",
) -> DataFrame:
    """Long form: one row for each scored row and threshold. No shuffle."""
    variants = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            *[v.alias(n) for n, v in _outcome(t, accept_rate, key).items()],
        )
        for t in thresholds
    ]
    return scored.select(key, "y_actual", "y_pred", F.inline(F.array(*variants)))


def offer_scenario_wide(
    scored: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    accept_rate: float = ACCEPT_RATE,
    key: str = "subid",
) -> DataFrame:
    """Wide form: columns ``get_offer_0_5``, ``plan_0_5`` … for each threshold. No shuffle."""
    added = [
        value.alias(f"{name}_{threshold_tag(t)}")
        for t in thresholds
        for name, value in _outcome(t, accept_rate, key).items()
    ]
    return scored.select(key, "y_actual", "y_pred", *added)


def plan_counts(wide: DataFrame, threshold: float) -> DataFrame:
    """Non-null counts of all columns by the plan at one threshold."""
    return group_nonnull_counts(wide, [f"plan_{threshold_tag(threshold)}"])


def actual_counts(wide: DataFrame) -> DataFrame:
    """Non-null counts of all columns by the actual label."""
    return group_nonnull_counts(wide, ["y_actual"])
