"""Column-expression helpers shared by the operators."""

from subtide.functions.draws import pick, u01, u01_sql
from subtide.functions.exprs import (
    converted,
    days_between,
    ratio,
    threshold_tag,
    with_year_month,
    zero_to_one,
)

__all__ = [
    "converted",
    "days_between",
    "pick",
    "ratio",
    "threshold_tag",
    "u01",
    "u01_sql",
    "with_year_month",
    "zero_to_one",
]
