"""Acquisition cost of each subscriber and customer lifetime value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.functions import ratio
from subtide.operators.profile import nan_to_null
from subtide.operators.relational import lookup_join
from subtide.sources import materialize

# Channels that cost nothing, spelled as in the data.
ORGANIC_CHANNELS = (
    "organic",
    "google_organic",
    "bing_organic",
    "pininterest_organic",
    "facebook_organic",
)
# Mean CAC for other unknown channels, discount rate of one billing
# period, and months of a billing period.
DEFAULT_CAC = 5.521
DISCOUNT_RATE = 0.03
PERIOD_MONTHS = 4


def mean_cac(channel_table: DataFrame) -> DataFrame:
    """Mean CAC over the channel-months that have one, as one row."""
    return channel_table.agg(F.avg("cac").alias("mean_cac"))


# Columns of a modelling row that its acquisition cost and lifetime value need.
COST_COLUMNS = (
    "month",
    "year",
    "attribution_technical",
    "monthly_price",
    "discount_price",
    "join_fee",
)


def with_costs(
    rows: DataFrame,
    channel_table: DataFrame,
    default_cac: float | None = DEFAULT_CAC,
    organic: Sequence[str] = ORGANIC_CHANNELS,
    key: str = "subid",
) -> DataFrame:
    """CAC of each row by sign-up month and channel; unknown join fees are 0.

    ``rows`` have the :data:`COST_COLUMNS`; other columns stay. Organic channels cost
    0. Other channels without a CAC get ``default_cac``, or the mean CAC of the
    channel table if that is ``None``. The channel table, a row for each month and
    channel, is written once and then joined by
    :func:`subtide.operators.relational.lookup_join`.
    """
    lookup = materialize(channel_table.select("year", "month", "attribution", "cac"), "cac")
    fallback = mean_cac(lookup).scalar() if default_cac is None else F.lit(float(default_cac))
    known = nan_to_null(rows).withColumnRenamed("attribution_technical", "attribution")
    known = known.withColumn("join_fee", F.coalesce("join_fee", F.lit(0.0)))
    joined = lookup_join(known, lookup, ["year", "month", "attribution"], spread_by=key)
    filled = F.when(F.col("attribution").isin(*organic), 0.0).otherwise(
        F.coalesce(F.col("cac"), fallback)
    )
    return joined.select(*known.columns, "cac", filled.alias("cac_filled"))


def subscriber_cac(
    features: DataFrame,
    channel_table: DataFrame,
    default_cac: float | None = DEFAULT_CAC,
    organic: Sequence[str] = ORGANIC_CHANNELS,
) -> DataFrame:
    """:func:`with_costs` of the modelling table, without its other columns."""
    return with_costs(features.select("subid", *COST_COLUMNS), channel_table, default_cac, organic)


def clv(
    costed: DataFrame,
    discount_rate: float = DISCOUNT_RATE,
    periods: int = PERIOD_MONTHS,
    with_cac: bool = True,
) -> DataFrame:
    """Lifetime value of each scored row: future, first period, join fee, less CAC.

    ``costed`` is what :func:`with_costs` makes of scored rows that carry the cost
    columns, so a row's score and costs never part and nothing is joined here. The
    future is the period price times (1 + d) / ((1 + d) - (1 - p)), where p is the
    predicted probability to churn.
    """
    price = F.col("discount_price") * periods
    growth = F.lit(1 + discount_rate)
    future = price * ratio(growth, growth - (1 - F.col("y_pred")))
    value = future + price + F.col("join_fee")
    name = "clv_with_cac" if with_cac else "clv_without_cac"
    if with_cac:
        value = value - F.col("cac_filled")
    return costed.withColumn(name, value)
