"""Queries of the churn label, the engagement features and the model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.operators import churn, encode, relational
from subtide.operators.churn import MEASURES, PROFILE_COLUMNS
from subtide.plans.inputs import Inputs
from subtide.plans.oracle import u01
from subtide.plans.registry import query
from subtide.sources import materialize

FEATURE_COLUMNS = [
    "subid",
    "account_creation_date",
    "payment_period",
    "churn",
    *[f"{m}_trial" for m in MEASURES],
    *[f"{m}_sum_daily" for m in MEASURES],
    *PROFILE_COLUMNS,
    "year",
    "month",
]


def features(t: Inputs) -> DataFrame:
    return churn.churn_feature_table(t.subscribers, t.customer_service, t.engagement)


def stored_features(t: Inputs) -> DataFrame:
    """The modelling table written once, for queries that read it more than once."""
    return materialize(features(t), "features")


@query(
    "churn_label",
    "SELECT subid, payment_period, CASE WHEN renew = false THEN 1 WHEN current_sub_tf = false THEN 1 "
    "WHEN revenue_net_1month <= 0 THEN 1 ELSE 0 END AS churn FROM customer_service",
)
def churn_label(t: Inputs) -> DataFrame:
    return churn.with_churn_label(t.customer_service).select("subid", "payment_period", "churn")


@query(
    "churn_cohort",
    "SELECT subid, account_creation_date, revenue_net_1month, payment_period, renew, churn FROM cohort",
)
def churn_cohort(t: Inputs) -> DataFrame:
    ids = relational.id_intersection(t.engagement, t.subscribers, t.customer_service)
    return churn.paying_cohort(t.customer_service, ids)


@query("trial_features", "SELECT * FROM trial")
def trial_features(t: Inputs) -> DataFrame:
    return churn.trial_engagement(t.engagement)


@query("daily_features", "SELECT * FROM daily")
def daily_features(t: Inputs) -> DataFrame:
    return churn.daily_engagement(t.engagement)


@query("churn_features", f"SELECT {', '.join(FEATURE_COLUMNS)} FROM features")
def churn_features(t: Inputs) -> DataFrame:
    return features(t)


@query("churn_features_stored", f"SELECT {', '.join(FEATURE_COLUMNS)} FROM features")
def churn_features_stored(t: Inputs) -> DataFrame:
    """The feature table from tables that are stored in buckets by subscriber."""
    return churn.subscriber_store(t.subscribers, t.customer_service, t.engagement).features()


@query(
    "churn_by_period",
    "SELECT c.payment_period, count(*) AS rows, CAST(sum(churn) AS BIGINT) AS churned, "
    "count(DISTINCT c.subid) AS subscribers, sum(coalesce(t.app_opens_trial, 0)) AS app_opens_trial "
    "FROM (SELECT subid, payment_period, CASE WHEN renew = false THEN 1 WHEN current_sub_tf = false THEN 1 "
    "WHEN revenue_net_1month <= 0 THEN 1 ELSE 0 END AS churn FROM customer_service "
    "WHERE trial_completed_tf AND revenue_net_1month > 0) c "
    "JOIN (SELECT subid FROM subscribers WHERE refund_after_trial_tf = false "
    "AND plan_type IN ('base_uae_14_day_trial', 'low_uae_no_trial', 'high_uae_14_day_trial')) s ON c.subid = s.subid "
    "JOIN (SELECT DISTINCT subid FROM engagement) e ON c.subid = e.subid "
    "LEFT JOIN trial t ON c.subid = t.subid GROUP BY c.payment_period",
)
def churn_by_period(t: Inputs) -> DataFrame:
    """Churn of all payment periods; one store serves the join and the count by subscriber."""
    table = churn.subscriber_store(t.subscribers, t.customer_service, t.engagement).features(period=None)
    by_subscriber = table.groupBy("payment_period", "subid").agg(
        F.count("*").alias("n"), F.sum("churn").alias("churned"), F.sum("app_opens_trial").alias("app_opens_trial")
    )
    return by_subscriber.groupBy("payment_period").agg(
        F.sum("n").alias("rows"),
        F.sum("churned").alias("churned"),
        F.count("*").alias("subscribers"),
        F.sum("app_opens_trial").alias("app_opens_trial"),
    )


@query(
    "fill_constant",
    "SELECT subid, coalesce(op_sys, 'iOS') AS op_sys, coalesce(package_type, 'no_package') AS package_type, "
    "coalesce(join_fee, 0) AS join_fee FROM subscribers",
)
def fill_constant(t: Inputs) -> DataFrame:
    rows = t.subscribers.select("subid", "op_sys", "package_type", "join_fee")
    return churn.fill_constant(rows, {**churn.FILL_CONSTANTS, "join_fee": 0.0})


@query(
    "impute_categorical",
    "SELECT subid, preferred_genre, intended_use FROM features",
)
def impute_categorical(t: Inputs) -> DataFrame:
    return features(t).select("subid", "preferred_genre", "intended_use")


@query(
    "impute_observed",
    "SELECT s.subid, coalesce(s.op_sys, c.op_sys) AS op_sys FROM (SELECT subid, op_sys, "
    f"{u01('subid', 'impute_op_sys')} AS u FROM subscribers) s LEFT JOIN ("
    "SELECT op_sys, (sum(n) OVER (ORDER BY op_sys) - n) / CAST(sum(n) OVER () AS DOUBLE) AS low, "
    "sum(n) OVER (ORDER BY op_sys) / CAST(sum(n) OVER () AS DOUBLE) AS high "
    "FROM (SELECT op_sys, count(*) AS n FROM subscribers WHERE op_sys IS NOT NULL GROUP BY op_sys)) c "
    "ON s.op_sys IS NULL AND s.u >= c.low AND s.u < c.high",
)
def impute_observed(t: Inputs) -> DataFrame:
    return churn.impute_categorical(t.subscribers.select("subid", "op_sys"), "op_sys")


@query(
    "split_counts",
    "SELECT is_train, count(*) AS rows, CAST(sum(churn) AS BIGINT) AS churned FROM ("
    "SELECT subid NOT IN (SELECT subid FROM scored) AS is_train, churn FROM features) GROUP BY is_train",
)
def split_counts(t: Inputs) -> DataFrame:
    marked = encode.with_split(features(t))
    return marked.groupBy("is_train").agg(
        F.count("*").alias("rows"), F.sum("churn").alias("churned")
    )


# The levels that occur in the sample tables; the first of each is left out.
_DUMMIES = {
    "package_type": ["enhanced", "no_package"],
    "preferred_genre": ["drama", "international", "other", "regional"],
    "intended_use": [
        "education",
        "expand international access",
        "expand regional access",
        "other",
        "replace OTT",
        "supplement OTT",
    ],
    "male_tf": ["true"],
    "op_sys": ["iOS"],
    "plan_type": ["high_uae_14_day_trial", "low_uae_no_trial"],
    "payment_type": ["Standard Charter"],
}


@query(
    "dummy_encode",
    "SELECT subid, churn, "
    + ", ".join(
        f"CAST(coalesce(CAST({c} AS VARCHAR) = '{level}', false) AS INT) AS {encode.dummy_name(c, level)}"
        for c, levels in _DUMMIES.items()
        for level in levels
    )
    + " FROM features",
)
def dummy_encode(t: Inputs) -> DataFrame:
    rows = stored_features(t).select("subid", "churn", *encode.CATEGORICAL)
    return encode.dummy_encode(rows)


@query(
    "sparse_categories",
    "SELECT subid, count(spot) = 0 AS is_empty, CAST(coalesce(sum(spot + 1), 0) AS BIGINT) AS places, "
    "count(spot) AS n FROM (SELECT f.subid, l.spot FROM (SELECT subid, unnest(generate_series(0, 6)) AS place, "
    f"unnest([{', '.join(f'CAST({c} AS VARCHAR)' for c in encode.CATEGORICAL)}]) AS level FROM features) f "
    "LEFT JOIN (SELECT place, level, CASE WHEN k > 1 THEN number - 1 - firsts END AS spot FROM ("
    "SELECT place, level, row_number() OVER (ORDER BY place, level) AS number, row_number() OVER (PARTITION BY place ORDER BY level) AS k, "
    "dense_rank() OVER (ORDER BY place) AS firsts FROM (SELECT DISTINCT place, level FROM (SELECT unnest(generate_series(0, 6)) AS place, "
    f"unnest([{', '.join(f'CAST({c} AS VARCHAR)' for c in encode.CATEGORICAL)}]) AS level FROM features) WHERE level IS NOT NULL))) l "
    "ON f.place = l.place AND f.level = l.level) GROUP BY subid",
)
def sparse_categories(t: Inputs) -> DataFrame:
    """Places of a row's categories in its sparse vector: none at all, their sum from 1, their number."""
    rows = stored_features(t).select("subid", *encode.CATEGORICAL)
    at = F.unwrap_udt("categories")["indices"]
    total = F.aggregate(at, F.lit(0).cast("bigint"), lambda a, x: a + x + 1)
    return encode.sparse_encode(rows).select("subid", (F.size(at) == 0).alias("is_empty"), total.alias("places"), F.size(at).cast("bigint").alias("n"))


@query(
    "dummy_encode_nulls",
    "SELECT subid, CAST(coalesce(package_type = 'enhanced', false) AS INT) AS package_type_enhanced, "
    "CAST(coalesce(op_sys = 'iOS', false) AS INT) AS op_sys_ios FROM subscribers",
)
def dummy_encode_nulls(t: Inputs) -> DataFrame:
    rows = t.subscribers.select("subid", "package_type", "op_sys")
    return encode.dummy_encode(rows, ["package_type", "op_sys"])
