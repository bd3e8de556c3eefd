"""Joins, id sets, de-duplication and reshaping."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.operators.profile import quoted

# Rows that the sketch of hot keys may come from are counted by this many counters for each key asked for.
SKETCH = 10
# The sketch cannot tell more keys than this apart; the largest ones are found first.
MOST_HOT = 100_000


def merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi-join on named keys; other columns both sides have get a suffix."""
    keys = list(on)
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, keys, how)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: str,
    salts: int | None = None,
) -> DataFrame:
    """Left join of a big table to a lookup table with one row for each key.

    Every key is split ``salts`` ways by a hash of ``spread_by``, and the lookup
    repeated for each, so a key with a large share of the rows is spread over many
    tasks if the big side is shuffled. Left out, ``salts`` is the root of the number of
    shuffle partitions: it grows with them, and the repeated lookup stays small. What
    is still uneven, adaptive execution splits, as both sides come straight from a
    shuffle. Whether there is one, or the lookup is broadcast, is left to Spark, which
    goes by bytes.
    """
    keys = list(on)
    salts = salts or math.ceil(math.sqrt(_partitions(left)))
    salt = F.pmod(F.xxhash64(quoted(spread_by)), F.lit(salts)).cast("int")
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], "left").drop("_salt")


def hot_keys(df: DataFrame, key: str, share: float | None = None) -> dict:
    """Keys that hold at least ``share`` of the rows, each with its own share.

    Left out, ``share`` is a quarter of what an even task has. One pass with a
    bounded sketch, whose counts are estimates: at most 1 / share keys come back.
    Which keys are found only decides how a join runs.
    """
    share = share or 1 / (4 * _partitions(df))
    most = min(math.ceil(1 / share), MOST_HOT)
    top, total = df.agg(
        F.expr(f"approx_top_k({quoted(key)}, {most}, {SKETCH * most})"), F.count("*")
    ).first()
    return {
        r["item"]: r["count"] / total
        for r in top
        if r["item"] is not None and r["count"] >= share * total
    }


def join_splitting_hot_keys(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    share: float | None = None,
) -> DataFrame:
    """Inner, left or left-semi join of rows to a table with about one row for each key.

    A key that holds a large share of ``left`` would fill a single task. Its rows are
    dealt to as many tasks as its share is worth, by a hash of the whole row, and the
    right rows of that key are repeated for each. All keys together are repeated at
    most five times as often as there are shuffle partitions. The other rows are
    joined as usual, and so is everything if no key is hot.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"an inner, left or left_semi join, not {how!r}")
    hot = hot_keys(left, key, share)
    if not hot:
        return left.join(right, key, how)
    tasks = _partitions(left)
    rows = [(k, max(1, math.ceil(part * tasks))) for k, part in hot.items()]
    schema = T.StructType([T.StructField(key, left.schema[key].dataType), T.StructField("_salts", T.IntegerType())])
    # At most 1 / share rows, which bounds the broadcast.
    splits = F.broadcast(left.sparkSession.createDataFrame(rows, schema))
    marked = left.join(splits, key, "left")
    whole_row = F.xxhash64(*[quoted(c) for c in left.columns])
    apart = marked.where("_salts IS NOT NULL").withColumn("_salt", F.pmod(whole_row, F.col("_salts")).cast("int"))
    few = right.select(key).distinct() if how == "left_semi" else right
    few = few.join(splits, key).withColumn("_salt", F.explode(F.expr("sequence(0, _salts - 1)"))).drop("_salts")
    apart = apart.join(few, [key, "_salt"], how).drop("_salts", "_salt")
    return marked.where("_salts IS NULL").drop("_salts").join(right, key, how).unionByName(apart)


def keep_ids(
    df: DataFrame, ids: DataFrame, key: str = "subid", share: float | None = None
) -> DataFrame:
    """Rows whose key is in ``ids`` (left-semi join; no id list on the driver)."""
    return join_splitting_hot_keys(df, ids.select(key), key, "left_semi", share)


def id_intersection(*frames: DataFrame, key: str = "subid") -> DataFrame:
    """Distinct keys present in every frame.

    Each frame contributes one bit and a key qualifies when all bits are set.
    That is a single shuffle for any number of frames, and copies of a key are
    folded before it.
    """
    tagged = [
        f.where(F.col(key).isNotNull()).select(key, F.lit(1 << i).cast("long").alias("_bit"))
        for i, f in enumerate(frames)
    ]
    seen = reduce(DataFrame.unionAll, tagged).groupBy(key).agg(F.bit_or("_bit").alias("_bits"))
    return seen.where(F.col("_bits") == (1 << len(frames)) - 1).select(key)


def dedup_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key: the smallest by ``order``, known values first.

    Ties are broken by the remaining columns, so the result does not depend on
    how the rows are partitioned. Written as an aggregate, which folds the copies
    of a key before the shuffle; a ranking window would move all of them.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    ranked = [x for c in [*order, *rest] for x in (F.col(c).isNull(), F.col(c))]
    names = [x for c in [*order, *rest] for x in (f"_null_{c}", c)]
    row = F.struct(*[x.alias(n) for x, n in zip(ranked, names)])
    first = df.groupBy(key).agg(F.min(row).alias("_first"))
    picked = [F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns]
    return first.select(*picked)


def unpivot_channels(
    spend: DataFrame, ids: Sequence[str] = ("year", "month"), value: str = "spend"
) -> DataFrame:
    """Wide to long: one row for each id and channel that has a value."""
    channels = [c for c in spend.columns if c not in ids]
    return spend.unpivot(list(ids), channels, "attribution", value).where(F.col(value).isNotNull())
