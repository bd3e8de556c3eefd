"""URL filters: rules by host and path, then trust and distrust spread over the link graph.

A rule names a host and the start of a path; it fits the host and all its subdomains,
and the longest rule that fits decides. What no rule decides, the graph does. Its
nodes are hosts, its edges the links of the pages from one host to another, weighted
by their number. Four amounts start at each host: its allowed pages and all its pages
go along the links, its blocked pages and all its pages against them (a host answers
for what it links to). Each round passes on a share ``DAMPING`` of what came in the
last, divided by the weight of the edges; the sums over the rounds are personalised
PageRanks. A host's trust is the part of the rank reaching it that stems from allowed
pages, its distrust the part of the reversed rank that stems from blocked ones. A host
is blocked if its distrust is at least ``MARGIN`` percent above its trust.

Amounts are whole numbers of ``UNIT`` to a page, rounded down, so results are the same
however the work is dealt out. After ``ROUNDS`` rounds under 0.6 % of an amount is
still on its way; the rounds end sooner when nothing is. All of it is DataFrame
functions. Hot hosts are salted; each round is a stored table.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no
rule, is no node and is allowed. Null html has no links. Links within a host are none.
Rows are judged one by one, repeated ones as well; each counts as a page. Of rules of
one length the one with the longer host wins. An empty table gives an empty result.
Extra columns are not carried.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.operators.relational import lookup_join
from subtide.sources import materialize

UNIT = 10**6
DAMPING = 85  # percent
ROUNDS = 32
MARGIN = 50  # percent
# An attribute with an address that names a host; the host is the group.
LINK = (
    "[ \\t\\n\\f\\r\"'/](?:[hH][rR][eE][fF]|[sS][rR][cC])[ \\t\\n\\f\\r]*=[ \\t\\n\\f\\r]*[\"']?"
    "(?:[hH][tT][tT][pP][sS]?:)?//([^/?#\"'<> \\t\\n\\f\\r]+)"
)

Rule = tuple[str, str]  # such as ("example.net/en/", "allow")


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Given rules as a table (rule, verdict)."""
    rows = [F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")) for rule, verdict in rules]
    given = F.array(*rows) if rows else F.from_json(F.lit("[]"), "array<struct<rule:string,verdict:string>>")
    return spark.range(1).select(F.inline(given))


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parsed(pages: DataFrame, *carry: str) -> DataFrame:
    """``page_id``, ``host`` and ``path`` of each page, and the columns to carry."""
    url = F.coalesce("url", F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    split = pages.select("page_id", *carry, rest.alias("rest"))
    host, path = F.regexp_extract("rest", "^[^/?#]*", 0), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1)
    return split.select("page_id", *carry, _lower(host).alias("host"), path.alias("path"))


def by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``n`` (a number for the row), ``page_id``, ``host``, ``path``, and ``rule`` and ``verdict`` where one fits."""
    cut = rules.select(
        "rule", "verdict", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("start")
    )
    entry = F.struct((-F.length("rule")).alias("short"), (-F.length("suffix")).alias("wide"), "start", "rule", "verdict")
    of_suffix = cut.groupBy("suffix").agg(F.collect_list(entry).alias("fits"))
    labels = cut.agg(F.max(F.size(F.split("suffix", "[.]")))).first()[0] or 1
    rows = parsed(pages).withColumn("n", F.monotonically_increasing_id())
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    hosts = parsed(pages).select("host").distinct().select("host", F.explode(ends).alias("suffix"))
    found = lookup_join(hosts, of_suffix, ["suffix"], "host").filter("fits IS NOT NULL")
    of_host = found.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("fits"))).alias("fits"))
    first = F.get(F.filter("fits", lambda f: F.startswith(F.col("path"), f["start"])), F.lit(0))
    judged = lookup_join(rows, of_host, ["host"], "n").withColumn("first", first)
    return judged.select("n", "page_id", "host", "path", "first.rule", "first.verdict")


def links(pages: DataFrame) -> DataFrame:
    """``src``, ``dst`` and ``w``, the number of links from one host to another."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    pairs = parsed(pages, "html").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    pairs = pairs.withColumn("dst", _lower(F.col("dst"))).filter("src <> '' AND src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("w"))


def arcs(edges: DataFrame) -> DataFrame:
    """Edges both ways, each with the ``total`` weight that leaves its start."""
    stored = materialize(edges, "links")
    onward = stored.select(F.lit("onward").alias("way"), "src", "dst", "w")
    back = stored.select(F.lit("back").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = onward.union(back)
    totals = both.groupBy("way", "src").agg(F.sum("w").alias("total"))
    return materialize(lookup_join(both, totals, ["way", "src"], "dst"), "arcs")


def propagate(seeds: DataFrame, given: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """Sums of all rounds by ``way`` and ``host``: ``marked`` and ``pages``.

    ``seeds`` has the columns way, host, marked and pages, in units; ``given`` is the
    result of :func:`arcs`.
    """

    def share(amount: str) -> Column:
        return F.sum(F.expr(f"CAST({amount} AS DECIMAL(38, 0)) * w * {damping} div (CAST(total AS DECIMAL(38, 0)) * 100)"))

    flow = materialize(seeds, "flow")
    flows = [flow]
    for _ in range(rounds):
        at = flow.withColumnRenamed("host", "src")
        sent = lookup_join(given, at, ["way", "src"], "dst").filter("pages > 0")
        came = sent.groupBy("way", F.col("dst").alias("host")).agg(share("marked").alias("marked"), share("pages").alias("pages"))
        flow = materialize(came.filter("pages > 0"), "flow")
        if flow.isEmpty():
            break
        flows.append(flow)
    total = flows[0]
    for flow in flows[1:]:
        total = total.union(flow)
    return total.groupBy("way", "host").agg(F.sum("marked").alias("marked"), F.sum("pages").alias("pages"))


def host_scores(judged: DataFrame, given: DataFrame, margin: int = MARGIN) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` (0 to 1) and ``blocked``, for hosts that have pages."""
    of_verdict = lambda v: F.count_if(F.col("verdict").eqNullSafe(F.lit(v)))
    counts = judged.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), of_verdict("allow").alias("allowed"), of_verdict("block").alias("blocked")
    )
    start = lambda way, marked: F.struct(F.lit(way).alias("way"), (F.col(marked) * UNIT).alias("marked"), (F.col("pages") * UNIT).alias("pages"))
    seeds = counts.select("host", F.inline(F.array(start("onward", "allowed"), start("back", "blocked"))))
    seeds = seeds.select("way", "host", "marked", "pages")
    ranks = propagate(seeds, given)
    of_way = lambda way, name: F.sum(F.when(F.col("way") == way, F.col(name))).cast("decimal(19,0)")
    both = ranks.groupBy("host").agg(
        of_way("onward", "marked").alias("t"),
        of_way("onward", "pages").alias("t_all"),
        of_way("back", "marked").alias("d"),
        of_way("back", "pages").alias("d_all"),
    )
    both = both.filter("t_all > 0 AND d_all > 0")
    return both.select(
        "host",
        F.expr("CAST(t AS DOUBLE) / CAST(t_all AS DOUBLE)").alias("trust"),
        F.expr("CAST(d AS DOUBLE) / CAST(d_all AS DOUBLE)").alias("distrust"),
        F.expr(f"100 * (d * t_all - t * d_all) >= {margin} * (d_all * t_all)").alias("blocked"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, margin: int = MARGIN) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` of each page."""
    judged = materialize(by_rules(pages, rules), "url-rules")
    blocked = host_scores(judged, arcs(links(pages)), margin).filter("blocked").select("host", "blocked")
    of_host = F.when(F.col("blocked"), "block").otherwise("allow")
    found = lookup_join(judged, blocked, ["host"], "n")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", of_host).alias("verdict"))
