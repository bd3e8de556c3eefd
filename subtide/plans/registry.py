"""The query registry.

A query is a function of :class:`~subtide.plans.inputs.Inputs`. Its oracle is a
DuckDB statement over the common table expressions of
:mod:`subtide.plans.oracle`; a query without one is checked by tests only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subtide.plans.inputs import Inputs
from subtide.plans.oracle import with_inputs

BUILDERS: dict[str, Callable[[Inputs], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function as query ``name``, with its oracle body."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(spark, sf_dir))

        BUILDERS[name] = build
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_inputs(sql)
        return build

    return register
