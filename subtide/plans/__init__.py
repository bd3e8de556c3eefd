"""Registered queries over the sample tables and their SQL oracles."""

from subtide.plans.registry import BUILDERS, ORACLES, QUERIES
from subtide.plans import (  # noqa: F401  (importing registers the queries)
    abtest_plans,
    channel_plans,
    check_plans,
    churn_plans,
    metric_plans,
    model_plans,
    profile_plans,
    revenue_plans,
)

__all__ = ["BUILDERS", "ORACLES", "QUERIES"]
