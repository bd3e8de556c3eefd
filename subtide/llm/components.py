"""Connected components by alternating stars, one stored table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import salted_join
from subtide.sources import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    upward = both.filter("v > u")
    return salted_join(upward, least, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = salted_join(edges, least, ["u"], F.col("v")).filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for all but the roots.

    ``edges`` has the columns ``u`` and ``v`` (long). Rounds go on until one
    changes nothing; each is stored in the shared folder, so no lineage grows and
    a lost executor costs one round's tasks at most.
    """
    links = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = materialize(links.distinct(), "components")
    mark = None
    while True:
        links = materialize(_small_star(_large_star(links)), "components")
        row = links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or row[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(row)
