"""Queries of the profiling, relational and reshaping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.functions import with_year_month
from subtide.operators import channel, churn, profile, relational
from subtide.plans.inputs import Inputs
from subtide.plans.oracle import COMPLETE, MEASURES
from subtide.plans.registry import query
from subtide.sources import load_spend_csv, scratch_path, split_spend_csv, write_csv

ALL_ENGAGEMENT = ("subid", "date", "payment_period", *MEASURES)


@query(
    "drop_any_null",
    f"SELECT {', '.join(ALL_ENGAGEMENT)} FROM engagement WHERE {COMPLETE}",
)
def drop_any_null(t: Inputs) -> DataFrame:
    return profile.drop_any_null(t.engagement)


@query(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM engagement"
        for c in ALL_ENGAGEMENT
    ),
)
def null_profile(t: Inputs) -> DataFrame:
    return profile.null_profile(t.engagement)


@query(
    "null_rate",
    "SELECT (count(*) - count(attribution_survey)) / CAST(count(*) AS DOUBLE) AS null_rate "
    "FROM subscribers",
)
def null_rate(t: Inputs) -> DataFrame:
    return profile.null_rate(t.subscribers, "attribution_survey")


@query("distinct_count", "SELECT count(DISTINCT subid) AS distinct_count FROM customer_service")
def distinct_count(t: Inputs) -> DataFrame:
    return profile.distinct_count(t.customer_service, "subid")


@query("row_count", "SELECT count(*) AS rows FROM customer_service")
def row_count(t: Inputs) -> DataFrame:
    return profile.row_count(t.customer_service)


@query(
    "min_max",
    "SELECT min(account_creation_date) AS min_value, max(account_creation_date) AS max_value "
    "FROM customer_service",
)
def min_max(t: Inputs) -> DataFrame:
    return profile.min_max(t.customer_service, "account_creation_date")


@query("value_counts", "SELECT plan_type, count(*) AS n FROM subscribers GROUP BY plan_type")
def value_counts(t: Inputs) -> DataFrame:
    return profile.value_counts(t.subscribers, "plan_type")


@query(
    "value_shares",
    "SELECT preferred_genre, CAST(count(*) AS DOUBLE) / (SELECT count(preferred_genre) FROM subscribers) "
    "AS share FROM subscribers WHERE preferred_genre IS NOT NULL GROUP BY preferred_genre",
)
def value_shares(t: Inputs) -> DataFrame:
    return profile.value_shares(t.subscribers, "preferred_genre")


@query(
    "group_nonnull_counts",
    "SELECT attribution_survey, op_sys, count(subid) AS subid, count(package_type) AS package_type, "
    "count(preferred_genre) AS preferred_genre, count(join_fee) AS join_fee FROM subscribers "
    "WHERE attribution_survey IS NOT NULL AND op_sys IS NOT NULL GROUP BY attribution_survey, op_sys",
)
def group_nonnull_counts(t: Inputs) -> DataFrame:
    columns = ["attribution_survey", "op_sys", "subid", "package_type", "preferred_genre", "join_fee"]
    return profile.group_nonnull_counts(
        t.subscribers.select(*columns), ["attribution_survey", "op_sys"]
    )


@query("monthly_accounts", "SELECT year, month, sample_accounts AS accounts FROM sub_months")
def monthly_accounts(t: Inputs) -> DataFrame:
    return profile.monthly_accounts(t.subscribers)


@query(
    "group_sums",
    f"SELECT subid, payment_period, {', '.join(f'sum({m}) AS {m}' for m in MEASURES)} "
    f"FROM engagement WHERE {COMPLETE} GROUP BY subid, payment_period",
)
def group_sums(t: Inputs) -> DataFrame:
    complete = profile.drop_any_null(t.engagement)
    return profile.group_sums(complete, ["subid", "payment_period"], churn.MEASURES)


@query(
    "group_mixed_agg",
    "SELECT subid, min(date) AS date_min, max(date) AS date_max, "
    f"{', '.join(f'sum({m}) AS {m}_sum' for m in MEASURES)} "
    f"FROM engagement WHERE {COMPLETE} AND payment_period <> 0 GROUP BY subid",
)
def group_mixed_agg(t: Inputs) -> DataFrame:
    rows = profile.drop_any_null(t.engagement).where(F.col("payment_period") != 0)
    return profile.group_mixed_agg(rows, "subid", "date", churn.MEASURES)


@query(
    "pearson_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 8) AS r "
        f"FROM engagement WHERE {COMPLETE}"
        for a in MEASURES
        for b in MEASURES
        if a != b
    ),
)
def pearson_pairs(t: Inputs) -> DataFrame:
    pairs = profile.pearson_pairs(t.engagement, churn.MEASURES)
    return pairs.select("col_a", "col_b", F.round("r", 8).alias("r"))


@query("pearson_p_values")
def pearson_p_values(t: Inputs) -> DataFrame:
    return profile.pearson_pairs(t.engagement, churn.MEASURES, p_values=True)


@query(
    "id_intersection",
    "SELECT subid FROM known_ids",
)
def id_intersection(t: Inputs) -> DataFrame:
    return relational.id_intersection(t.engagement, t.subscribers, t.customer_service)


@query(
    "id_intersection_pair",
    "SELECT subid FROM engagement INTERSECT SELECT subid FROM subscribers",
)
def id_intersection_pair(t: Inputs) -> DataFrame:
    return relational.id_intersection(t.engagement, t.subscribers)


@query(
    "dedup_first",
    "SELECT subid, account_creation_date, payment_period, renew, current_sub_tf, trial_completed_tf, "
    "revenue_net_1month FROM cs_first",
)
def dedup_first(t: Inputs) -> DataFrame:
    return relational.dedup_first(
        t.customer_service, "subid", ["account_creation_date", "payment_period"]
    )


@query(
    "unpivot_spend",
    " UNION ALL ".join(
        f"SELECT year, month, '{c}' AS attribution, {c} AS spend FROM ad_spend WHERE {c} IS NOT NULL"
        for c in ("facebook", "email", "search")
    ),
)
def unpivot_spend(t: Inputs) -> DataFrame:
    return relational.unpivot_channels(t.ad_spend)


def _by_channel(name: str, flag: str) -> str:
    return (
        f"(SELECT year, month, attribution_technical AS attribution, count(subid) AS users "
        f"FROM pay_flags WHERE attribution_technical IN ('facebook', 'email', 'search') AND {flag} "
        f"GROUP BY ALL) {name}"
    )


@query(
    "join_inner",
    f"SELECT t.year, t.month, t.attribution, t.users AS users_x, p.users AS users_y "
    f"FROM {_by_channel('t', 'true')} JOIN {_by_channel('p', 'paying')} "
    f"ON t.year = p.year AND t.month = p.month AND t.attribution = p.attribution",
)
def join_inner(t: Inputs) -> DataFrame:
    channels = channel.spend_channels(t.ad_spend)
    total = channel.user_counts(t.subscribers, channels)
    paying = channel.user_counts(t.subscribers, channels, users=channel.converted())
    return relational.merge(total, paying, channel.KEYS)


@query(
    "join_left",
    "SELECT c.subid, churn, t.app_opens_trial, t.num_videos_rated_trial "
    "FROM cohort c LEFT JOIN trial t ON c.subid = t.subid",
)
def join_left(t: Inputs) -> DataFrame:
    ids = relational.id_intersection(t.engagement, t.subscribers, t.customer_service)
    cohort = churn.paying_cohort(t.customer_service, ids).select("subid", "churn")
    trial = churn.trial_engagement(t.engagement, ("app_opens", "num_videos_rated"))
    return relational.merge(cohort, trial, ["subid"], "left")


@query(
    "join_right",
    f"SELECT s.year, s.month, s.attribution, u.users, s.spend FROM {_by_channel('u', 'paying')} "
    f"RIGHT JOIN spend_pared s "
    f"ON s.year = u.year AND s.month = u.month AND s.attribution = u.attribution",
)
def join_right(t: Inputs) -> DataFrame:
    channels = channel.spend_channels(t.ad_spend)
    paying = channel.user_counts(t.subscribers, channels, users=channel.converted())
    coverage = channel.coverage_by_month(t.subscribers, t.customer_service)
    spend = channel.pare_spend(t.ad_spend, coverage)
    return relational.merge(paying, spend, channel.KEYS, "right")


@query(
    "join_semi",
    "SELECT subid, payment_period, revenue_net_1month FROM customer_service "
    "WHERE subid IN (SELECT subid FROM known_ids)",
)
def join_semi(t: Inputs) -> DataFrame:
    ids = relational.id_intersection(t.engagement, t.subscribers, t.customer_service)
    rows = t.customer_service.select("subid", "payment_period", "revenue_net_1month")
    return relational.keep_ids(rows, ids)


@query("spend_typed", "SELECT year, month, facebook, email, search FROM ad_spend")
def spend_typed(t: Inputs) -> DataFrame:
    """Spend written as text with thousands separators and read back as numbers."""
    spend = t.ad_spend
    money = [F.format_number(c, 6).alias(c) for c in channel.spend_channels(spend)]
    path = scratch_path(t.spark, "spend")
    write_csv(spend.select(F.make_date("year", "month", F.lit(1)).alias("date"), *money), path)
    return load_spend_csv(t.spark, path)


def _split_spend(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """Good and rejected records of spend written as text, with an unreadable amount in two months a year."""
    spend = t.ad_spend
    amount = {c: F.format_number(c, 6) for c in channel.spend_channels(spend)}
    amount["email"] = F.when(F.col("month") % 5 == 0, "n/a").otherwise(amount["email"])
    path = scratch_path(t.spark, "spend")
    write_csv(spend.select(F.make_date("year", "month", F.lit(1)).alias("date"), *[v.alias(c) for c, v in amount.items()]), path)
    return split_spend_csv(t.spark, path)


@query("spend_accepted", "SELECT year, month, facebook, email, search FROM ad_spend WHERE month % 5 <> 0")
def spend_accepted(t: Inputs) -> DataFrame:
    return _split_spend(t)[0]


@query(
    "spend_rejected",
    "SELECT strftime(make_date(year, month, 1), '%Y-%m-%d') AS day, 'email' AS bad_columns FROM ad_spend WHERE month % 5 = 0",
)
def spend_rejected(t: Inputs) -> DataFrame:
    bad = _split_spend(t)[1]
    return bad.select(F.substring("record", 1, 10).alias("day"), F.concat_ws(",", "bad_columns").alias("bad_columns"))


@query(
    "distinct_by_month",
    "SELECT year(account_creation_date) AS year, count(DISTINCT subid) AS distinct_count FROM customer_service GROUP BY 1",
)
def distinct_by_month(t: Inputs) -> DataFrame:
    """Distinct subscribers of each year, merged from bitmaps by month."""
    dated = with_year_month(t.customer_service, "account_creation_date")
    by_month = profile.distinct_bitmaps(dated, "subid", ["year", "month"])
    return profile.count_bitmaps(profile.merge_bitmaps(by_month, ["year"]), ["year"]).withColumn("year", F.col("year").cast("bigint"))
