"""Churn label, engagement features and the modelling table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions import days_between, pick, u01, with_year_month, zero_to_one
from subtide.operators.abtest import MAIN_PLANS
from subtide.operators.ordering import in_ranges, running_sums
from subtide.operators.profile import drop_any_null, nan_to_null, quoted, value_shares
from subtide.operators.relational import hot_keys, join_splitting_hot_keys, keep_ids
from subtide.sources import CUSTOMER_SERVICE, ENGAGEMENT, SUBSCRIBERS, materialize, require, store_by_key

# The engagement measures.
MEASURES = (
    "app_opens",
    "cust_service_mssgs",
    "num_videos_completed",
    "num_videos_more_than_30_seconds",
    "num_videos_rated",
    "num_series_started",
)
# Category probabilities used to fill unknown answers.
GENRE_SHARES = {
    "comedy": 0.65,
    "drama": 0.24,
    "regional": 0.052,
    "international": 0.033,
    "other": 0.025,
}
INTENDED_USE_SHARES = {
    "access to exclusive content": 0.40,
    "replace OTT": 0.28,
    "supplement OTT": 0.11,
    "expand regional access": 0.085,
    "expand international access": 0.071,
    "education": 0.027,
    "other": 0.027,
}
# Constants for unknown categories.
FILL_CONSTANTS = {"op_sys": "iOS", "package_type": "no_package"}
# Subscriber columns taken into the modelling table.
PROFILE_COLUMNS = (
    "plan_type",
    "attribution_technical",
    "package_type",
    "preferred_genre",
    "intended_use",
    "op_sys",
    "payment_type",
    "male_tf",
    "monthly_price",
    "discount_price",
    "join_fee",
    "refund_after_trial_tf",
)


def churn_label() -> Column:
    """1 if the subscriber left: no renewal, no access, or no revenue left; else 0.

    A null answer decides nothing and the next one is asked.
    """
    return (
        F.when(~F.col("renew"), 1)
        .when(~F.col("current_sub_tf"), 1)
        .when(F.col("revenue_net_1month") <= 0, 1)
        .otherwise(0)
    )


def with_churn_label(cs: DataFrame) -> DataFrame:
    """Add the ``churn`` label to customer-service rows."""
    require(cs, CUSTOMER_SERVICE, ["renew", "current_sub_tf", "revenue_net_1month"])
    return cs.withColumn("churn", churn_label())


def paying_cohort(cs: DataFrame, ids: DataFrame | None = None, period: int | None = 1) -> DataFrame:
    """Labelled rows of subscribers who completed the trial and paid in ``period`` (None: in any).

    ``ids`` narrows the cohort to some subscribers.
    """
    require(cs, CUSTOMER_SERVICE)
    rows = cs.where(
        (F.lit(True) if period is None else F.col("payment_period") == period)
        & F.col("trial_completed_tf")
        & (F.col("revenue_net_1month") > 0)
    ).select(
        "subid",
        "account_creation_date",
        "revenue_net_1month",
        "payment_period",
        "renew",
        churn_label().alias("churn"),
    )
    return rows if ids is None else keep_ids(rows, ids)


def trial_engagement(
    engagement: DataFrame, measures: Sequence[str] = MEASURES, ids: DataFrame | None = None
) -> DataFrame:
    """Sums of each measure over a subscriber's complete trial rows, ``<measure>_trial``."""
    require(engagement, ENGAGEMENT)
    rows = drop_any_null(engagement).where(F.col("payment_period") == 0)
    sums = rows.groupBy("subid").agg(*[F.sum(quoted(m)).alias(f"{m}_trial") for m in measures])
    return sums if ids is None else sums.join(ids.select("subid"), "subid", "left_semi")


def daily_engagement(
    engagement: DataFrame, measures: Sequence[str] = MEASURES, ids: DataFrame | None = None
) -> DataFrame:
    """Sums after the trial for each day between first and last use, ``<measure>_sum_daily``."""
    require(engagement, ENGAGEMENT)
    rows = drop_any_null(engagement).where(F.col("payment_period") != 0)
    sums = rows.groupBy("subid").agg(
        F.min("date").alias("_from"), F.max("date").alias("_to"), *[F.sum(quoted(m)).alias(m) for m in measures]
    )
    days = zero_to_one(days_between(F.col("_from"), F.col("_to")))
    daily = [f"try_divide({quoted(m)}, _days) AS {quoted(m + '_sum_daily')}" for m in measures]
    features = sums.withColumn("_days", days).selectExpr("subid", *daily)
    return features if ids is None else features.join(ids.select("subid"), "subid", "left_semi")


def engagement_features(engagement: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Trial and daily features of every subscriber with any engagement row.

    The same values as :func:`trial_engagement` and :func:`daily_engagement`, with
    0 where a subscriber has no complete row of that kind, from one scan and one
    shuffle. The rows present are the subscribers of the uncleaned table, so an
    inner join with this frame also applies the membership test.
    """
    require(engagement, ENGAGEMENT)
    engagement = nan_to_null(engagement)
    complete = " AND ".join(f"{quoted(c)} IS NOT NULL" for c in engagement.columns)
    in_trial, after = f"{complete} AND payment_period = 0", f"{complete} AND payment_period <> 0"
    marked = engagement.selectExpr(
        "subid", "date", *map(quoted, measures), f"{in_trial} AS _in_trial", f"{after} AS _after"
    )
    sums = marked.groupBy("subid").agg(
        F.expr("min(date) FILTER (WHERE _after) AS _from"),
        F.expr("max(date) FILTER (WHERE _after) AS _to"),
        *[F.expr(f"sum({quoted(m)}) FILTER (WHERE _in_trial) AS {quoted(m + '_trial')}") for m in measures],
        *[F.expr(f"sum({quoted(m)}) FILTER (WHERE _after) AS {quoted(m + '_sum')}") for m in measures],
    )
    days = zero_to_one(days_between(F.col("_from"), F.col("_to")))
    return sums.withColumn("_days", days).selectExpr(
        "subid",
        *[f"coalesce({quoted(m + '_trial')}, 0D) AS {quoted(m + '_trial')}" for m in measures],
        *[
            f"coalesce(try_divide({quoted(m + '_sum')}, _days), 0D) AS {quoted(m + '_sum_daily')}"
            for m in measures
        ],
    )


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls of the named columns by constants."""
    return df.na.fill(dict(values))


def observed_shares(df: DataFrame, column: str) -> dict[str, float]:
    """Shares of a column of few categories as plan-time values, one for each branch of a choice."""
    return dict(sorted((r[column], r["share"]) for r in value_shares(df, column).collect()))


def impute_categorical(
    df: DataFrame,
    column: str,
    shares: Mapping[str, float] | None = None,
    key: str = "subid",
) -> DataFrame:
    """Fill each null with a category drawn by ``shares``, or by those observed.

    The draw depends on the row's key only, see :func:`subtide.functions.u01`.
    Observed shares stay a table, so a column may have any number of categories.
    """
    # The draw is a column of its own, made for unknown answers only, so that it
    # is worked out once and not again in every branch of the choice.
    unknown = F.when(F.col(column).isNull(), u01(key, f"impute_{column}"))
    drawn = df.withColumn("_draw", unknown)
    if shares is None:
        return _impute_observed(drawn, column).select(*map(quoted, df.columns))
    chosen = pick(F.col("_draw"), list(shares), list(shares.values()))
    return drawn.withColumn(column, F.coalesce(F.col(column), chosen)).drop("_draw")


def category_slices(df: DataFrame, column: str) -> DataFrame:
    """``category``, ``low`` and ``high``: the slices of [0, 1) by observed share, in the categories' order."""
    counts = df.where(F.col(quoted(column)).isNotNull()).groupBy(F.col(quoted(column)).alias("category")).agg(F.count("*").alias("n"))
    summed = running_sums(in_ranges(counts, ["category"], "categories"), ["category"], {"upto": "n"})
    total = summed.agg(F.max("upto")).scalar()
    edge = lambda c: F.col(c).cast("double") / total
    return materialize(summed.withColumn("from", F.col("upto") - F.col("n")).select("category", edge("from").alias("low"), edge("upto").alias("high")), "slices")


def _impute_observed(drawn: DataFrame, column: str) -> DataFrame:
    """Fill nulls by their ``_draw`` from the observed shares.

    [0, 1) is cut into as many cells as there are categories. A slice is listed in the
    cells it touches, two for each category in the mean; a draw meets the slices of its cell only.
    """
    slices = category_slices(drawn, column)
    cells = max(slices.count(), 1)
    salts = math.ceil(math.sqrt(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cell = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1))
    listed = slices.withColumn("_cell", F.explode(F.sequence(cell("low"), cell("high"))))
    listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    empty = drawn.where(F.col(quoted(column)).isNull()).withColumns({"_cell": cell("_draw"), "_salt": spread})
    within = (empty["_cell"] == listed["_cell"]) & (empty["_salt"] == listed["_salt"])
    within &= (F.col("_draw") >= F.col("low")) & (F.col("_draw") < F.col("high"))
    filled = empty.join(listed, within, "left").drop(empty["_cell"], listed["_cell"], empty["_salt"], listed["_salt"])
    filled = filled.withColumn(column, F.col("category")).select(*map(quoted, drawn.columns))
    return drawn.where(F.col(quoted(column)).isNotNull()).unionByName(filled)


def churn_feature_table(
    subscribers: DataFrame,
    cs: DataFrame,
    engagement: DataFrame,
    plans: Sequence[str] = MAIN_PLANS,
    period: int = 1,
) -> DataFrame:
    """One modelling row for each paying-cohort row of a known, engaged subscriber.

    Subscribers must be in all three tables, be on one of ``plans`` and not have
    been refunded after the trial. A sketch of the cohort's keys comes first, in a job
    of its own; filters reach the scans. Engagement is folded to one row by subscriber and joined to the
    profile first, on the partitioning that the fold left. The cohort, the only
    side that may have many rows for a key, comes last, with hot keys apart.
    """
    cohort = paying_cohort(cs, period=period).drop("renew", "revenue_net_1month")
    return _completed(join_splitting_hot_keys(cohort, _engaged(subscribers, engagement, plans), "subid"))


def _engaged(subscribers: DataFrame, engagement: DataFrame, plans: Sequence[str]) -> DataFrame:
    """Engagement and profile of each engaged subscriber of the plans who was not refunded."""
    require(subscribers, SUBSCRIBERS, ["subid", *PROFILE_COLUMNS])
    profile = subscribers.where(
        ~F.col("refund_after_trial_tf") & F.col("plan_type").isin(*plans)
    ).select("subid", *PROFILE_COLUMNS)
    return engagement_features(engagement).join(profile, "subid")


def _completed(table: DataFrame) -> DataFrame:
    """Unknown answers filled, year and month added."""
    table = impute_categorical(table, "preferred_genre", GENRE_SHARES)
    table = impute_categorical(table, "intended_use", INTENDED_USE_SHARES)
    table = fill_constant(table, FILL_CONSTANTS)
    return with_year_month(table, "account_creation_date")


@dataclass(frozen=True)
class SubscriberStore:
    """What :func:`churn_feature_table` joins, stored in buckets by subscriber.

    ``rows`` are the labelled rows of all periods, ``known`` has one row for each
    subscriber. Rows of subscribers with a large share of all rows would fill one
    bucket; they are in ``hot``, stored as they come.
    """

    rows: DataFrame
    hot: DataFrame | None
    known: DataFrame

    def features(self, period: int | None = 1) -> DataFrame:
        """The feature table of a period (None: of all), joined without a shuffle by subscriber."""
        of = lambda rows: rows if period is None else rows.where(F.col("payment_period") == period)
        table = of(self.rows).join(self.known, "subid")
        if self.hot is not None:
            table = table.unionByName(join_splitting_hot_keys(of(self.hot), self.known, "subid"))
        return _completed(table)


def subscriber_store(
    subscribers: DataFrame,
    cs: DataFrame,
    engagement: DataFrame,
    plans: Sequence[str] = MAIN_PLANS,
    buckets: int | None = None,
    share: float | None = None,
) -> SubscriberStore:
    """Store labelled rows and known subscribers for several feature tables.

    A subscriber with at least ``share`` of the labelled rows is hot, see
    :func:`~subtide.operators.relational.hot_keys`. Rows without a subscriber are in no
    feature table and not stored. Subscribers are not repeated in ``subscribers``.
    """
    rows = paying_cohort(cs, period=None).drop("renew", "revenue_net_1month").where("subid IS NOT NULL")
    keys = list(hot_keys(rows, "subid", share))
    is_hot = F.col("subid").isin(*keys)
    hot = materialize(rows.where(is_hot), "hot-cohort") if keys else None
    cold = rows.where(~is_hot) if keys else rows
    known = _engaged(subscribers, engagement, plans)
    return SubscriberStore(store_by_key(cold, "cohort", ["subid"], buckets), hot, store_by_key(known, "known", ["subid"], buckets))
