"""Column contracts of the four input tables.

Operators call :func:`require` on entry, so a missing or wrongly typed column
fails while the plan is built and not in the middle of a job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TEXT, _FLAG, _NUM = T.StringType(), T.BooleanType(), T.DoubleType()
_DATE, _INT, _ID = T.DateType(), T.IntegerType(), T.LongType()

SUBSCRIBERS = (
    T.StructType()
    .add("subid", _ID, False)
    .add("account_creation_date", _DATE)
    .add("plan_type", _TEXT)
    .add("cancel_before_trial_end", _FLAG)
    .add("refund_after_trial_tf", _FLAG)
    .add("retarget_tf", _FLAG)
    .add("attribution_technical", _TEXT)
    .add("attribution_survey", _TEXT)
    .add("package_type", _TEXT)
    .add("preferred_genre", _TEXT)
    .add("intended_use", _TEXT)
    .add("op_sys", _TEXT)
    .add("payment_type", _TEXT)
    .add("male_tf", _FLAG)
    .add("monthly_price", _NUM)
    .add("discount_price", _NUM)
    .add("join_fee", _NUM)
)

CUSTOMER_SERVICE = (
    T.StructType()
    .add("subid", _ID, False)
    .add("account_creation_date", _DATE)
    .add("payment_period", _INT)
    .add("renew", _FLAG)
    .add("current_sub_tf", _FLAG)
    .add("trial_completed_tf", _FLAG)
    .add("revenue_net_1month", _NUM)
)

ENGAGEMENT = (
    T.StructType()
    .add("subid", _ID, False)
    .add("date", _DATE)
    .add("payment_period", _INT)
    .add("app_opens", _NUM)
    .add("cust_service_mssgs", _NUM)
    .add("num_videos_completed", _NUM)
    .add("num_videos_more_than_30_seconds", _NUM)
    .add("num_videos_rated", _NUM)
    .add("num_series_started", _NUM)
)

# The spend table also has one money column for each channel, known only from
# its header.
AD_SPEND_KEYS = T.StructType().add("year", _INT, False).add("month", _INT, False)


def _family(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(data_type, T.NumericType):
        return "number"
    return data_type.simpleString()


def require(df: DataFrame, contract: T.StructType, columns: Iterable[str] | None = None) -> None:
    """Raise ``ValueError`` unless ``df`` has the contract's columns and types.

    Types are compared by family (date or timestamp, any number, text, flag).
    ``columns`` narrows the check to those an operator reads.
    """
    present = {field.name.lower(): field.dataType for field in df.schema.fields}
    for name in columns if columns is not None else contract.names:
        expected = _family(contract[name].dataType)
        if name not in present:
            raise ValueError(f"column {name!r} is missing; found {sorted(present)}")
        found = _family(present[name])
        if found != expected:
            raise ValueError(f"column {name!r} must be a {expected}, found {found}")
