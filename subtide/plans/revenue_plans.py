"""Queries of the offer scenarios and of customer lifetime value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.operators import clv, models, scenario
from subtide.plans.channel_plans import technical_cac
from subtide.plans.churn_plans import features
from subtide.plans.inputs import Inputs
from subtide.plans.metric_plans import fixed_score
from subtide.plans.oracle import u01
from subtide.plans.registry import query


# Stated here again, so that a wrong value in the operators shows.
THRESHOLDS = (0.5, 0.3, 0.7)


def _outcome_sql(t: float) -> str:
    """Outcome of one threshold as columns offer, accept, base, plan."""
    return (
        f"SELECT *, CASE WHEN accept = 1 THEN 'offer' WHEN base = 1 THEN 'base' ELSE 'churn' END AS plan "
        f"FROM (SELECT *, CAST(y_actual = 0 AND accept = 0 AS INT) AS base FROM (SELECT *, "
        f"CAST(offer = 1 AND {u01('subid', f'accept{t:g}')} <= CAST(0.3 AS DOUBLE) AS INT) AS accept "
        f"FROM (SELECT *, CAST(y_pred >= CAST({t} AS DOUBLE) AS INT) AS offer FROM scored)))"
    )


def _tag(t: float) -> str:
    return f"{t:g}".replace(".", "_")


def _wide_sql() -> str:
    joins = " ".join(f"JOIN ({_outcome_sql(t)}) t{_tag(t)} USING (subid)" for t in THRESHOLDS)
    columns = ", ".join(
        f"t{_tag(t)}.offer AS get_offer_{_tag(t)}, t{_tag(t)}.accept AS accept_offer_{_tag(t)}, "
        f"t{_tag(t)}.base AS renew_at_base_{_tag(t)}, t{_tag(t)}.plan AS plan_{_tag(t)}"
        for t in THRESHOLDS
    )
    return f"SELECT s.subid, s.y_actual, s.y_pred, {columns} FROM scored s {joins}"


_WIDE_COLUMNS = [
    "subid",
    "y_actual",
    "y_pred",
    *[
        f"{name}_{_tag(t)}"
        for t in THRESHOLDS
        for name in ("get_offer", "accept_offer", "renew_at_base", "plan")
    ],
]


def _counts_sql(key: str) -> str:
    counts = ", ".join(f"count({c}) AS {c}" for c in _WIDE_COLUMNS if c != key)
    return f"SELECT {key}, {counts} FROM ({_wide_sql()}) GROUP BY {key}"


@query(
    "offer_scenario_long",
    " UNION ALL ".join(
        f"SELECT subid, y_actual, y_pred, CAST({t} AS DOUBLE) AS threshold, offer AS get_offer, "
        f"accept AS accept_offer, base AS renew_at_base, plan FROM ({_outcome_sql(t)})"
        for t in THRESHOLDS
    ),
)
def offer_scenario_long(t: Inputs) -> DataFrame:
    return scenario.offer_scenario(fixed_score(features(t)))


@query("offer_scenario_wide", _wide_sql())
def offer_scenario_wide(t: Inputs) -> DataFrame:
    return scenario.offer_scenario_wide(fixed_score(features(t)))


@query("offer_plan_counts", _counts_sql("plan_0_3"))
def offer_plan_counts(t: Inputs) -> DataFrame:
    return scenario.plan_counts(scenario.offer_scenario_wide(fixed_score(features(t))), 0.3)


@query("offer_plan_counts_70", _counts_sql("plan_0_7"))
def offer_plan_counts_70(t: Inputs) -> DataFrame:
    return scenario.plan_counts(scenario.offer_scenario_wide(fixed_score(features(t))), 0.7)


@query("offer_actual_counts", _counts_sql("y_actual"))
def offer_actual_counts(t: Inputs) -> DataFrame:
    return scenario.actual_counts(scenario.offer_scenario_wide(fixed_score(features(t))))


@query("subscriber_cac", "SELECT * FROM sub_cac")
def subscriber_cac(t: Inputs) -> DataFrame:
    return clv.subscriber_cac(features(t), technical_cac(t))


@query(
    "subscriber_cac_mean",
    "SELECT * EXCLUDE (cac_filled), round(CASE WHEN attribution IN ('organic', 'google_organic', "
    "'bing_organic', 'pininterest_organic', 'facebook_organic') THEN CAST(0 AS DOUBLE) "
    "ELSE coalesce(cac, (SELECT avg(cac) FROM cac_technical)) END, 8) AS cac_filled FROM sub_cac",
)
def subscriber_cac_mean(t: Inputs) -> DataFrame:
    rows = clv.subscriber_cac(features(t), technical_cac(t), default_cac=None)
    return rows.withColumn("cac_filled", F.round("cac_filled", 8))


_CLV = (
    "SELECT s.subid, s.y_actual, s.y_pred, c.month, c.year, c.attribution, c.monthly_price, "
    "c.discount_price, c.join_fee, c.cac, c.cac_filled, "
    "c.discount_price * 4 * (CAST(1.03 AS DOUBLE) / (CAST(1.03 AS DOUBLE) - (1 - s.y_pred))) "
    "+ c.discount_price * 4 + c.join_fee {less} AS {name} "
    "FROM scored s LEFT JOIN sub_cac c ON s.subid = c.subid"
)


def _fixed_score_clv(t: Inputs, with_cac: bool) -> DataFrame:
    costed = clv.with_costs(fixed_score(features(t), clv.COST_COLUMNS), technical_cac(t))
    return clv.clv(costed, with_cac=with_cac)


@query("clv_with_cac", _CLV.format(less="- c.cac_filled", name="clv_with_cac"))
def clv_with_cac(t: Inputs) -> DataFrame:
    return _fixed_score_clv(t, with_cac=True)


@query("clv_without_cac", _CLV.format(less="", name="clv_without_cac"))
def clv_without_cac(t: Inputs) -> DataFrame:
    return _fixed_score_clv(t, with_cac=False)


@query("clv_of_tree_score")
def clv_of_tree_score(t: Inputs) -> DataFrame:
    """The whole chain on the fitted tree: score, acquisition cost, lifetime value."""
    data = models.prepare(features(t))
    scored = models.score(models.fit(data, "tree"), data.test, clv.COST_COLUMNS).drop("y_label")
    return clv.clv(clv.with_costs(scored, technical_cac(t)))


@query("offers_of_tree_score")
def offers_of_tree_score(t: Inputs) -> DataFrame:
    """Offer scenarios over the fitted tree's scores."""
    data = models.prepare(features(t))
    scored = models.score(models.fit(data, "tree"), data.test)
    return scenario.offer_scenario_wide(scored)
