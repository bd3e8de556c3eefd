"""Running totals over a whole table, without a task that has all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.sources import materialize


def in_ranges(df: DataFrame, order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """The rows, stored, with ``_part``: all rows of a lower part come first in order.

    Spark samples the order columns to cut ranges of about equal size, as many as
    there are shuffle partitions unless ``parts`` is given. Equal rows share a part.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)


def running_sums(stored: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Add, under each name in ``sums``, the total of a column over the rows up to and including each.

    ``stored`` comes from :func:`in_ranges` with the same order, which no two rows share.
    The driver reads a row for each part, as many as there are shuffle partitions. Sums
    are of whole numbers.
    """
    totals = stored.groupBy("_part").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    before = [0] * len(sums)
    rows = []
    for part, *own in sorted(totals.collect()):
        rows.append((part, *before))
        before = [a + (b or 0) for a, b in zip(before, own)]
    schema = T.StructType([T.StructField(f if f == "_part" else f"_{f}", totals.schema[f].dataType) for f in totals.columns])
    base = F.broadcast(stored.sparkSession.createDataFrame(rows, schema))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = stored.withColumns({name: F.sum(c).over(within) for name, c in sums.items()}).join(base, "_part")
    kept = [F.col(f"`{c}`") for c in stored.columns if c != "_part"]
    return joined.select(*kept, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])
