"""Channel economics: coverage, pared spend, CPA, CAC and marginal changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.functions import converted, ratio
from subtide.operators.profile import monthly_accounts
from subtide.operators.relational import unpivot_channels
from subtide.sources import AD_SPEND_KEYS, CUSTOMER_SERVICE, SUBSCRIBERS, require

KEYS = ["year", "month", "attribution"]
# Fixed value: June holds only the last days of the first sign-up month.
EXCLUDED_MONTHS = (6,)


def spend_channels(spend: DataFrame) -> list[str]:
    """The channels of a wide spend table, which are its columns but the month's."""
    return [c for c in spend.columns if c not in ("year", "month")]


def coverage_by_month(sample: DataFrame, population: DataFrame) -> DataFrame:
    """Share of each month's population accounts that the sample holds.

    The population has several rows for each account and counts an account in
    the month of its first one. Only that date is needed, so the de-duplication
    is a ``min`` folded before the shuffle.
    """
    require(sample, SUBSCRIBERS, ["account_creation_date"])
    require(population, CUSTOMER_SERVICE, ["subid", "account_creation_date"])
    first_dates = population.groupBy("subid").agg(
        F.min("account_creation_date").alias("account_creation_date")
    )
    whole = monthly_accounts(first_dates).withColumnRenamed("accounts", "population_accounts")
    part = monthly_accounts(sample).withColumnRenamed("accounts", "sample_accounts")
    return whole.join(part, ["year", "month"]).withColumn(
        "percent", ratio(F.col("sample_accounts"), F.col("population_accounts"))
    )


def pare_spend(spend: DataFrame, coverage: DataFrame) -> DataFrame:
    """Spend scaled to the sample, in long form (year, month, attribution, spend).

    A month without coverage has no scaled spend and no rows.
    """
    require(spend, AD_SPEND_KEYS)
    keys = ["year", "month"]
    scaled = [(F.col(f"`{c}`") * F.col("percent")).alias(c) for c in spend_channels(spend)]
    joined = spend.join(coverage.select(*keys, "percent"), keys, "left")
    return unpivot_channels(joined.select(*keys, *scaled))


def _by_channel(df: DataFrame, group_col: str, date_col: str) -> DataFrame:
    known = df.where(F.col(group_col).isNotNull() & F.col(date_col).isNotNull())
    return known.groupBy(
        F.year(date_col).alias("year"),
        F.month(date_col).alias("month"),
        F.col(group_col).alias("attribution"),
    )


def user_counts(
    subscribers: DataFrame,
    channels: Sequence[str],
    filter_col: str = "attribution_technical",
    group_col: str = "attribution_technical",
    users: Column | None = None,
) -> DataFrame:
    """Users of each (year, month, channel) whose channel has spend data.

    ``users`` narrows the count to the rows for which it is true.
    """
    chosen = subscribers.where(F.col(filter_col).isin(*channels))
    if users is not None:
        chosen = chosen.where(users)
    grouped = _by_channel(chosen, group_col, "account_creation_date")
    return grouped.agg(F.count("subid").alias("users"))


def channel_cac(
    subscribers: DataFrame,
    spend_long: DataFrame,
    channels: Sequence[str],
    filter_col: str = "attribution_technical",
    group_col: str = "attribution_technical",
    exclude_months: Sequence[int] = EXCLUDED_MONTHS,
) -> DataFrame:
    """Cost per acquired user (CPA) and per paying user (CAC) by month and channel.

    Every spend row is kept. A channel-month without a paying user has neither
    count, so both ratios are null there. Total and paying users are counted in
    one pass over the subscribers and shuffled as partial counts; both join sides
    then have one row for each channel and month.
    """
    require(
        subscribers,
        SUBSCRIBERS,
        ["subid", "account_creation_date", "cancel_before_trial_end", "refund_after_trial_tf"],
    )
    chosen = subscribers.where(F.col(filter_col).isin(*channels))
    users = (
        _by_channel(chosen, group_col, "account_creation_date")
        .agg(
            F.count("subid").alias("total_users"),
            F.count(F.when(converted(), F.col("subid"))).alias("paying_users"),
        )
        .where(F.col("paying_users") > 0)
    )
    spend = spend_long.where(~F.col("month").isin(*exclude_months)) if exclude_months else spend_long
    return users.join(spend, KEYS, "right").select(
        *KEYS,
        "total_users",
        "paying_users",
        "spend",
        ratio(F.col("spend"), F.col("total_users")).alias("cpa"),
        ratio(F.col("spend"), F.col("paying_users")).alias("cac"),
    )


def marginal_change(channel_table: DataFrame) -> DataFrame:
    """Change of spend and users of a channel against the month before.

    Null where the month before is not in the table, so a gap is never bridged.
    """
    month_index = F.col("year") * 12 + F.col("month")
    window = Window.partitionBy("attribution").orderBy(month_index)
    adjacent = F.lag(month_index).over(window) == month_index - 1

    def change(column: str) -> Column:
        return F.when(adjacent, F.col(column) - F.lag(column).over(window))

    return channel_table.select(
        *KEYS,
        change("spend").alias("marginal_spend"),
        change("total_users").alias("marginal_users"),
    )
