"""Small column expressions with the null rules the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; a zero divisor gives null instead of an error."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def converted() -> Column:
    """Paying-user flag: trial-end flag set and no refund. Never null."""
    paying = F.col("cancel_before_trial_end") & ~F.col("refund_after_trial_tf")
    return F.coalesce(paying, F.lit(False))


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to a later end, for dates and timestamps alike."""
    return F.extract(F.lit("DAY"), end - start)


def zero_to_one(value: Column) -> Column:
    """Zero replaced by one, so that the value can be a divisor."""
    return F.when(value == 0, F.lit(1)).otherwise(value)


def with_year_month(df: DataFrame, date_col: str) -> DataFrame:
    """Add integer ``year`` and ``month`` columns taken from a date column."""
    return df.withColumns({"year": F.year(date_col), "month": F.month(date_col)})


def threshold_tag(threshold: float) -> str:
    """Column-name suffix of a threshold, all digits kept: 0.5 -> ``0_5``."""
    return repr(float(threshold)).removesuffix(".0").replace(".", "_")
