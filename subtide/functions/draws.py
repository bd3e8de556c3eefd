"""Repeatable random draws.

A draw is a function of a row's key and a salt, never of the row's place in a
partition: a retried task, another partitioning or another cluster size gives
the same value.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01_sql(key: str, salt: str) -> str:
    """SQL text of a uniform draw in [0, 1): the first 32 bits of md5(key || salt)."""
    digest = f"md5(CAST(concat(CAST({key} AS STRING), '{salt}') AS BINARY))"
    return f"(CAST(conv(substr({digest}, 1, 8), 16, 10) AS BIGINT) / 4294967296D)"


def u01(key: str, salt: str) -> Column:
    """Uniform draw in [0, 1) of a key column and a salt, see :func:`u01_sql`."""
    return F.expr(u01_sql(key, salt))


def pick(draw: Column, values: Sequence[str], weights: Sequence[float]) -> Column:
    """The value whose slice of [0, 1) holds the draw; slices follow ``weights``."""
    if len(values) != len(weights) or not values:
        raise ValueError("values and weights must be equally long and not empty")
    edges = list(accumulate(weights))
    if abs(edges[-1] - 1.0) > 1e-9:
        raise ValueError(f"weights must sum to 1, got {edges[-1]}")
    chosen = F
    for value, edge in zip(values[:-1], edges[:-1]):
        chosen = chosen.when(draw < edge, value)
    return chosen.otherwise(values[-1]) if len(values) > 1 else F.lit(values[0])
