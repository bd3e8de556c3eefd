"""Queries of channel economics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.operators import channel, clv, profile
from subtide.plans.inputs import Inputs
from subtide.plans.registry import query
from subtide.sources import materialize


def spend_long(t: Inputs) -> DataFrame:
    coverage = channel.coverage_by_month(t.subscribers, t.customer_service)
    return channel.pare_spend(t.ad_spend, coverage)


def technical_cac(t: Inputs) -> DataFrame:
    channels = channel.spend_channels(t.ad_spend)
    return channel.channel_cac(t.subscribers, spend_long(t), channels)


def _survey_cac(t: Inputs, group_col: str) -> DataFrame:
    channels = channel.spend_channels(t.ad_spend)
    return channel.channel_cac(
        t.subscribers, spend_long(t), channels, "attribution_survey", group_col
    )


@query(
    "coverage",
    "SELECT year, month, population_accounts, sample_accounts, percent FROM coverage",
)
def coverage(t: Inputs) -> DataFrame:
    return channel.coverage_by_month(t.subscribers, t.customer_service)


@query(
    "coverage_overall",
    "SELECT CAST((SELECT count(DISTINCT subid) FROM subscribers) AS DOUBLE) / "
    "(SELECT count(DISTINCT subid) FROM customer_service) AS distinct_ratio",
)
def coverage_overall(t: Inputs) -> DataFrame:
    return profile.rate_of_distinct(t.subscribers, t.customer_service)


@query("spend_pared", "SELECT year, month, attribution, spend FROM spend_pared")
def spend_pared(t: Inputs) -> DataFrame:
    return spend_long(t)


_CAC_COLUMNS = "year, month, attribution, total_users, paying_users, spend, cpa, cac"


@query("channel_cac", f"SELECT {_CAC_COLUMNS} FROM cac_technical")
def channel_cac(t: Inputs) -> DataFrame:
    return technical_cac(t)


@query("channel_cac_survey", f"SELECT {_CAC_COLUMNS} FROM cac_survey")
def channel_cac_survey(t: Inputs) -> DataFrame:
    return _survey_cac(t, "attribution_technical")


@query("channel_cac_survey_fixed", f"SELECT {_CAC_COLUMNS} FROM cac_survey_fixed")
def channel_cac_survey_fixed(t: Inputs) -> DataFrame:
    return _survey_cac(t, "attribution_survey")


@query("mean", "SELECT round(avg(cac), 8) AS mean_value FROM cac_technical")
def mean(t: Inputs) -> DataFrame:
    return profile.mean(technical_cac(t), "cac").select(F.round("mean_value", 8).alias("mean_value"))


# For the statement only: the sample orders run from 1995-01 to 2001-08, June is left out.
_PIVOT_MONTHS = [(y, m) for y in range(1995, 2002) for m in range(1, 13) if m != 6 and (y, m) <= (2001, 8)]


@query(
    "pivot_mean",
    "SELECT attribution, "
    + ", ".join(
        f"avg(spend) FILTER (year = {y} AND month = {m}) AS spend_{y}_{m:02d}, "
        f"avg(total_users) FILTER (year = {y} AND month = {m}) AS users_{y}_{m:02d}"
        for y, m in _PIVOT_MONTHS
    )
    + " FROM cac_technical GROUP BY attribution",
)
def pivot_mean(t: Inputs) -> DataFrame:
    values = {"spend": "spend", "total_users": "users"}
    return profile.pivot_mean(materialize(technical_cac(t), "cac"), "attribution", values)


@query(
    "marginal_spend",
    "SELECT a.year, a.month, a.attribution, a.spend - b.spend AS marginal_spend, "
    "a.total_users - b.total_users AS marginal_users FROM cac_technical a LEFT JOIN cac_technical b "
    "ON a.attribution = b.attribution AND a.year * 12 + a.month = b.year * 12 + b.month + 1",
)
def marginal_spend(t: Inputs) -> DataFrame:
    return channel.marginal_change(technical_cac(t))


@query("mean_cac", "SELECT round(avg(cac), 8) AS mean_cac FROM cac_survey")
def mean_cac(t: Inputs) -> DataFrame:
    survey = _survey_cac(t, "attribution_technical")
    return clv.mean_cac(survey).select(F.round("mean_cac", 8).alias("mean_cac"))
