"""The four input tables, derived from the sample order tables.

One subscription is one order. The derivation injects what the sample tables
lack: nulls, subscribers missing from some tables, an access loss that rises
with the price. :mod:`subtide.plans.oracle` states the same derivation in SQL.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import u01_sql
from subtide.operators.abtest import BASE_PLAN, HIGH_PLAN, LOW_PLAN
from subtide.sources import load_table, materialize


def _u01(salt: str) -> str:
    return u01_sql("o_orderkey", salt)


class Inputs:
    """Lazy readers of the derived tables for one sample folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.run_id = uuid.uuid4().hex

    def staged(self) -> Inputs:
        """The same tables, written once to the shared folder and read from there."""
        names = ("subscribers", "customer_service", "engagement", "ad_spend")
        copy = Inputs(self.spark, self.sf_dir)
        with ThreadPoolExecutor(len(names)) as pool:  # four independent jobs
            stored = pool.map(materialize, [getattr(self, n) for n in names], names)
        for name, table in zip(names, stored):
            setattr(copy, name, table)
        return copy

    def _table(self, name: str) -> DataFrame:
        return load_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _orders_with_customer(self) -> DataFrame:
        customer = self._table("customer")
        return self._table("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def subscribers(self) -> DataFrame:
        survey, genre, use = (_u01(salt) for salt in ("sv", "genre", "use"))
        return self._orders_with_customer.where("o_orderkey % 6 <> 0").selectExpr(
            "o_orderkey AS subid",
            "CAST(o_orderdate AS DATE) AS account_creation_date",
            f"CASE o_orderpriority WHEN '1-URGENT' THEN '{HIGH_PLAN}' WHEN '2-HIGH' THEN '{LOW_PLAN}' "
            f"WHEN '5-LOW' THEN 'other_plan' ELSE '{BASE_PLAN}' END AS plan_type",
            "o_orderstatus <> 'P' AS cancel_before_trial_end",
            f"{_u01('refund')} < 0.1D AS refund_after_trial_tf",
            "o_orderpriority = '2-HIGH' OR o_orderkey % 10 = 3 AS retarget_tf",
            "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'facebook' WHEN 'BUILDING' THEN 'email' "
            "WHEN 'FURNITURE' THEN 'search' WHEN 'MACHINERY' THEN 'organic' "
            "ELSE 'affiliate' END AS attribution_technical",
            f"CASE WHEN {survey} < 0.01D THEN NULL WHEN {survey} < 0.2D THEN 'email' "
            "WHEN c_mktsegment = 'AUTOMOBILE' THEN 'facebook' "
            "WHEN c_mktsegment = 'FURNITURE' THEN 'search' ELSE 'organic' END AS attribution_survey",
            "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'base' ELSE 'enhanced' END AS package_type",
            f"CASE WHEN {genre} < 0.15D THEN NULL WHEN {genre} < 0.7D THEN 'comedy' "
            "ELSE 'drama' END AS preferred_genre",
            f"CASE WHEN {use} < 0.1D THEN NULL WHEN {use} < 0.6D THEN 'replace OTT' "
            "ELSE 'education' END AS intended_use",
            "CASE WHEN o_orderkey % 40 = 1 THEN NULL WHEN c_nationkey < 12 THEN 'iOS' "
            "ELSE 'Android' END AS op_sys",
            f"CASE WHEN {_u01('pay')} < 0.5D THEN 'CBD' ELSE 'Standard Charter' END AS payment_type",
            "c_custkey % 2 = 0 AS male_tf",
            "o_totalprice / 90000 AS monthly_price",
            "o_totalprice / 100000 AS discount_price",
            "CASE WHEN o_orderkey % 4 <> 0 THEN abs(c_acctbal) / 10000 END AS join_fee",
        )

    @cached_property
    def customer_service(self) -> DataFrame:
        renew = _u01("renew")
        orders = self._table("orders").where("o_orderkey % 13 <> 0")
        # The draws are made once for an order, before it becomes three rows.
        flags = orders.selectExpr(
            "o_orderkey AS subid",
            "CAST(o_orderdate AS DATE) AS account_creation_date",
            f"CASE WHEN {renew} < 0.25D THEN NULL ELSE {renew} < 0.8D END AS renew",
            f"{_u01('cur')} < 1 - o_totalprice / 700000 AS current_sub_tf",
            f"{_u01('done')} < 0.9D AS trial_completed_tf",
            "CASE WHEN o_orderkey % 17 = 0 THEN 0D ELSE o_totalprice / 100000 END AS revenue_net_1month",
        )
        return flags.selectExpr(
            "subid",
            "account_creation_date",
            "explode(array(0, 1, 2)) AS payment_period",
            "renew",
            "current_sub_tf",
            "trial_completed_tf",
            "revenue_net_1month",
        )

    @cached_property
    def engagement(self) -> DataFrame:
        return self._table("lineitem").selectExpr(
            "l_orderkey AS subid",
            "CAST(l_shipdate AS DATE) AS date",
            "(l_linenumber - 1) % 3 AS payment_period",
            "l_quantity AS app_opens",
            "CAST(l_partkey % 4 AS DOUBLE) AS cust_service_mssgs",
            "CASE WHEN l_partkey % 50 <> 0 THEN CAST(floor(l_extendedprice / 5000) AS DOUBLE) END "
            "AS num_videos_completed",
            "CAST(floor(l_extendedprice / 4000) + l_suppkey % 3 AS DOUBLE) "
            "AS num_videos_more_than_30_seconds",
            "round(l_discount * 100, 0) AS num_videos_rated",
            "round(l_tax * 100, 0) AS num_series_started",
        )

    @cached_property
    def ad_spend(self) -> DataFrame:
        cents = "CAST(round(o_totalprice * 100, 0) AS BIGINT)"

        def spent(rows: str, channel: str) -> Column:
            total = f"sum({cents}) FILTER (WHERE {rows})"
            return F.expr(f"CAST({total} AS DOUBLE) / 1000000 AS {channel}")

        return self._orders_with_customer.groupBy(
            F.expr("year(o_orderdate) AS year"), F.expr("month(o_orderdate) AS month")
        ).agg(
            spent("c_mktsegment = 'AUTOMOBILE'", "facebook"),
            spent("c_mktsegment = 'BUILDING'", "email"),
            spent("c_mktsegment = 'FURNITURE' AND month(o_orderdate) <> 2", "search"),
        )
