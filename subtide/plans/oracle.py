"""DuckDB statements of the derived inputs and of shared intermediate results.

They follow the plain, table-by-table reading of the analysis (ranking windows,
one join for each table), independently of how the Spark operators are built.
"""

from __future__ import annotations

import re
from itertools import accumulate

# Stated here again, so that a wrong value in the operators shows.
GENRE_SHARES = {"comedy": 0.65, "drama": 0.24, "regional": 0.052, "international": 0.033, "other": 0.025}
INTENDED_USE_SHARES = {
    "access to exclusive content": 0.40,
    "replace OTT": 0.28,
    "supplement OTT": 0.11,
    "expand regional access": 0.085,
    "expand international access": 0.071,
    "education": 0.027,
    "other": 0.027,
}
MEASURES = (
    "app_opens",
    "cust_service_mssgs",
    "num_videos_completed",
    "num_videos_more_than_30_seconds",
    "num_videos_rated",
    "num_series_started",
)


def u01(key: str, salt: str) -> str:
    """The draw of :func:`subtide.functions.u01` as a DuckDB expression."""
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8) AS BIGINT) / 4294967296.0)"


def _pick(draw: str, shares: dict[str, float]) -> str:
    edges = list(accumulate(shares.values()))[:-1]
    values = list(shares)
    whens = " ".join(f"WHEN {draw} < CAST({e!r} AS DOUBLE) THEN '{v}'" for e, v in zip(edges, values))
    return f"CASE {whens} ELSE '{values[-1]}' END"


def _list(template: str) -> str:
    return ",\n  ".join(template.format(m=m) for m in MEASURES)


COMPLETE = "subid IS NOT NULL AND date IS NOT NULL AND payment_period IS NOT NULL AND " + " AND ".join(
    f"{m} IS NOT NULL" for m in MEASURES
)

_CTES = {
    "subscribers": f"""
SELECT o_orderkey AS subid, CAST(o_orderdate AS DATE) AS account_creation_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high_uae_14_day_trial'
    WHEN '2-HIGH' THEN 'low_uae_no_trial' WHEN '5-LOW' THEN 'other_plan'
    ELSE 'base_uae_14_day_trial' END AS plan_type,
  (o_orderstatus <> 'P') AS cancel_before_trial_end,
  ({u01('o_orderkey', 'refund')} < 0.1) AS refund_after_trial_tf,
  (o_orderpriority = '2-HIGH' OR o_orderkey % 10 = 3) AS retarget_tf,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'facebook' WHEN 'BUILDING' THEN 'email'
    WHEN 'FURNITURE' THEN 'search' WHEN 'MACHINERY' THEN 'organic'
    ELSE 'affiliate' END AS attribution_technical,
  CASE WHEN {u01('o_orderkey', 'sv')} < 0.01 THEN NULL
    WHEN {u01('o_orderkey', 'sv')} < 0.2 THEN 'email'
    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'facebook'
    WHEN c_mktsegment = 'FURNITURE' THEN 'search'
    ELSE 'organic' END AS attribution_survey,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'base'
    ELSE 'enhanced' END AS package_type,
  CASE WHEN {u01('o_orderkey', 'genre')} < 0.15 THEN NULL
    WHEN {u01('o_orderkey', 'genre')} < 0.7 THEN 'comedy' ELSE 'drama' END AS preferred_genre,
  CASE WHEN {u01('o_orderkey', 'use')} < 0.1 THEN NULL
    WHEN {u01('o_orderkey', 'use')} < 0.6 THEN 'replace OTT' ELSE 'education' END AS intended_use,
  CASE WHEN o_orderkey % 40 = 1 THEN NULL WHEN c_nationkey < 12 THEN 'iOS'
    ELSE 'Android' END AS op_sys,
  CASE WHEN {u01('o_orderkey', 'pay')} < 0.5 THEN 'CBD' ELSE 'Standard Charter' END AS payment_type,
  (c_custkey % 2 = 0) AS male_tf,
  o_totalprice / 90000 AS monthly_price,
  o_totalprice / 100000 AS discount_price,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE abs(c_acctbal) / 10000 END AS join_fee
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 6 <> 0""",
    "customer_service": f"""
SELECT o_orderkey AS subid, CAST(o_orderdate AS DATE) AS account_creation_date,
  CAST(pp AS INT) AS payment_period,
  CASE WHEN {u01('o_orderkey', 'renew')} < 0.25 THEN NULL
    ELSE {u01('o_orderkey', 'renew')} < 0.8 END AS renew,
  ({u01('o_orderkey', 'cur')} < 1 - o_totalprice / 700000) AS current_sub_tf,
  ({u01('o_orderkey', 'done')} < 0.9) AS trial_completed_tf,
  CASE WHEN o_orderkey % 17 = 0 THEN CAST(0 AS DOUBLE)
    ELSE o_totalprice / 100000 END AS revenue_net_1month
FROM orders CROSS JOIN (SELECT 0 AS pp UNION ALL SELECT 1 UNION ALL SELECT 2) p
WHERE o_orderkey % 13 <> 0""",
    "engagement": """
SELECT l_orderkey AS subid, CAST(l_shipdate AS DATE) AS date,
  CAST((l_linenumber - 1) % 3 AS INT) AS payment_period,
  l_quantity AS app_opens,
  CAST(l_partkey % 4 AS DOUBLE) AS cust_service_mssgs,
  CASE WHEN l_partkey % 50 = 0 THEN NULL
    ELSE CAST(floor(l_extendedprice / 5000) AS DOUBLE) END AS num_videos_completed,
  CAST(floor(l_extendedprice / 4000) AS DOUBLE)
    + CAST(l_suppkey % 3 AS DOUBLE) AS num_videos_more_than_30_seconds,
  round(l_discount * 100, 0) AS num_videos_rated,
  round(l_tax * 100, 0) AS num_series_started
FROM lineitem""",
    "ad_spend": """
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
  CAST(sum(CASE WHEN c_mktsegment = 'AUTOMOBILE'
    THEN CAST(round(o_totalprice * 100, 0) AS BIGINT) END) AS DOUBLE) / 1000000 AS facebook,
  CAST(sum(CASE WHEN c_mktsegment = 'BUILDING'
    THEN CAST(round(o_totalprice * 100, 0) AS BIGINT) END) AS DOUBLE) / 1000000 AS email,
  CAST(sum(CASE WHEN c_mktsegment = 'FURNITURE' AND month(o_orderdate) <> 2
    THEN CAST(round(o_totalprice * 100, 0) AS BIGINT) END) AS DOUBLE) / 1000000 AS search
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY year(o_orderdate), month(o_orderdate)""",
    "cs_first": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY subid ORDER BY account_creation_date, payment_period) AS rn
  FROM customer_service) WHERE rn = 1""",
    "cs_months": """
SELECT CAST(year(account_creation_date) AS INT) AS year, CAST(month(account_creation_date) AS INT) AS month,
  count(account_creation_date) AS population_accounts
FROM cs_first GROUP BY ALL""",
    "sub_months": """
SELECT CAST(year(account_creation_date) AS INT) AS year, CAST(month(account_creation_date) AS INT) AS month,
  count(account_creation_date) AS sample_accounts
FROM subscribers GROUP BY ALL""",
    "coverage": """
SELECT year, month, population_accounts, sample_accounts,
  CAST(sample_accounts AS DOUBLE) / population_accounts AS percent
FROM cs_months JOIN sub_months USING (year, month)""",
    "spend_pared": " UNION ALL ".join(
        f"""
SELECT s.year, s.month, '{c}' AS attribution, s.{c} * percent AS spend
FROM ad_spend s LEFT JOIN coverage k ON s.year = k.year AND s.month = k.month
WHERE s.{c} * percent IS NOT NULL"""
        for c in ("facebook", "email", "search")
    ),
    "pay_flags": """
SELECT *, CAST(year(account_creation_date) AS INT) AS year,
  CAST(month(account_creation_date) AS INT) AS month,
  (cancel_before_trial_end AND NOT refund_after_trial_tf) AS paying
FROM subscribers""",
    **{
        f"cac_{run}": f"""
SELECT s.year, s.month, s.attribution, total_users, paying_users, spend,
  spend / total_users AS cpa, spend / paying_users AS cac
FROM spend_pared s LEFT JOIN (
  SELECT t.*, paying_users FROM (
    SELECT year, month, {group} AS attribution, count(subid) AS total_users
    FROM pay_flags WHERE {keep} IN ('facebook', 'email', 'search') AND {group} IS NOT NULL GROUP BY ALL) t
  JOIN (
    SELECT year, month, {group} AS attribution, count(subid) AS paying_users
    FROM pay_flags WHERE {keep} IN ('facebook', 'email', 'search') AND {group} IS NOT NULL AND paying
    GROUP BY ALL) p ON t.year = p.year AND t.month = p.month AND t.attribution = p.attribution) u
  ON s.year = u.year AND s.month = u.month AND s.attribution = u.attribution
WHERE s.month <> 6"""
        for run, keep, group in (
            ("technical", "attribution_technical", "attribution_technical"),
            ("survey", "attribution_survey", "attribution_technical"),
            ("survey_fixed", "attribution_survey", "attribution_survey"),
        )
    },
    "known_ids": """
SELECT subid FROM engagement INTERSECT SELECT subid FROM subscribers
INTERSECT SELECT subid FROM customer_service""",
    "cohort": """
SELECT subid, account_creation_date, revenue_net_1month, payment_period, renew,
  CASE WHEN renew = false THEN 1 WHEN current_sub_tf = false THEN 1
    WHEN revenue_net_1month <= 0 THEN 1 ELSE 0 END AS churn
FROM customer_service
WHERE subid IN (SELECT subid FROM known_ids) AND payment_period = 1
  AND trial_completed_tf = true AND revenue_net_1month > 0""",
    "trial": f"""
SELECT subid,
  {_list('sum({m}) AS {m}_trial')}
FROM engagement WHERE {COMPLETE} AND payment_period = 0 GROUP BY subid""",
    "daily": f"""
SELECT subid,
  {_list('{m} / days AS {m}_sum_daily')}
FROM (
  SELECT subid, CASE WHEN max(date) = min(date) THEN 1 ELSE max(date) - min(date) END AS days,
    {_list('sum({m}) AS {m}')}
  FROM engagement WHERE {COMPLETE} AND payment_period <> 0 GROUP BY subid)""",
    "features": f"""
SELECT c.subid, c.account_creation_date, c.payment_period, c.churn,
  {_list('coalesce(t.{m}_trial, 0) AS {m}_trial')},
  {_list('coalesce(d.{m}_sum_daily, 0) AS {m}_sum_daily')},
  plan_type, attribution_technical, coalesce(package_type, 'no_package') AS package_type,
  coalesce(preferred_genre, {_pick(u01('c.subid', 'impute_preferred_genre'), GENRE_SHARES)})
    AS preferred_genre,
  coalesce(intended_use, {_pick(u01('c.subid', 'impute_intended_use'), INTENDED_USE_SHARES)})
    AS intended_use,
  coalesce(op_sys, 'iOS') AS op_sys, payment_type, male_tf, monthly_price, discount_price, join_fee,
  refund_after_trial_tf,
  CAST(year(c.account_creation_date) AS INT) AS year,
  CAST(month(c.account_creation_date) AS INT) AS month
FROM cohort c
LEFT JOIN trial t ON c.subid = t.subid
LEFT JOIN daily d ON c.subid = d.subid
LEFT JOIN (SELECT * FROM subscribers WHERE subid IN (SELECT subid FROM known_ids)) s
  ON c.subid = s.subid
WHERE refund_after_trial_tf = false
  AND plan_type IN ('base_uae_14_day_trial', 'low_uae_no_trial', 'high_uae_14_day_trial')""",
    "scored": f"""
SELECT subid, churn AS y_actual,
  round({u01('subid', 'score')} * CAST(0.6 AS DOUBLE)
    + CAST(0.4 AS DOUBLE) * churn * {u01('subid', 'lift')}, 3) AS y_pred
FROM features WHERE {u01('subid', 'split')} >= CAST(0.7 AS DOUBLE)""",
    "labelled": """
SELECT *, CAST(y_pred >= CAST(0.55 AS DOUBLE) AS INT) AS y_label FROM scored""",
    "matrix": """
SELECT count(*) FILTER (y_actual = 0 AND y_label = 0) AS tn,
  count(*) FILTER (y_actual = 0 AND y_label = 1) AS fp,
  count(*) FILTER (y_actual = 1 AND y_label = 0) AS fn,
  count(*) FILTER (y_actual = 1 AND y_label = 1) AS tp
FROM labelled""",
    "score_groups": """
SELECT y_pred AS score, count(*) FILTER (y_actual = 1) AS pos, count(*) FILTER (y_actual = 0) AS neg
FROM scored GROUP BY y_pred""",
    "score_running": """
SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tps,
  CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fps,
  lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg
FROM score_groups""",
    "class_totals": """
SELECT CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n FROM score_groups""",
    "sub_cac": """
SELECT f.subid, f.month, f.year, f.attribution_technical AS attribution, monthly_price, discount_price,
  coalesce(join_fee, 0) AS join_fee, k.cac,
  CASE WHEN f.attribution_technical IN ('organic', 'google_organic', 'bing_organic',
    'pininterest_organic', 'facebook_organic') THEN CAST(0 AS DOUBLE)
    ELSE coalesce(k.cac, CAST(5.521 AS DOUBLE)) END AS cac_filled
FROM features f LEFT JOIN cac_technical k
  ON f.year = k.year AND f.month = k.month AND f.attribution_technical = k.attribution""",
}


def with_inputs(body: str) -> str:
    """The statement, preceded by the common table expressions that it names."""
    used, text = [], body
    for name, cte in reversed(_CTES.items()):
        if re.search(rf"\b{name}\b", text):
            used.insert(0, f"{name} AS ({cte}\n)")
            text += cte
    return f"WITH {', '.join(used)}\n{body}" if used else body
