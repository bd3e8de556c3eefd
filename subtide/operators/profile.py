"""Column profiles, counts, shares, group aggregates and correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.functions import ratio


def drop_any_null(df: DataFrame) -> DataFrame:
    """Rows without a null (or NaN) in any column."""
    return df.na.drop("any")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of floating-point columns turned into null, so that one rule holds for unknown values."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    known = {c: F.when(~F.isnan(quoted(c)), F.col(quoted(c))) for c in floating}
    return df.withColumns(known) if known else df


def quoted(name: str) -> str:
    """A column name as it stands in SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count of nulls (and NaN) of each column, in one pass: (column, nulls)."""
    columns = list(columns or df.columns)
    known = nan_to_null(df)
    counts = known.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "nulls")


def null_rate(df: DataFrame, column: str) -> DataFrame:
    """Share of rows in which a column is null (or NaN), as one row."""
    return nan_to_null(df).agg(F.avg(F.col(quoted(column)).isNull().cast("double")).alias("null_rate"))


def distinct_count(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """Distinct non-null values; ``approx`` trades exactness for a sketch."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(count(F.col(column)).alias("distinct_count"))


def distinct_bitmaps(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """The distinct keys of each group as bitmaps: the group, ``bucket`` and ``bits``.

    For whole-number keys. A bitmap has the keys of one range of 32,768, so dense keys
    are shuffled as bits, and what is stored by group or month can be merged later.
    """
    value = F.col(quoted(key)).cast("long")
    marked = df.where(value.isNotNull()).select(
        *map(quoted, by), F.bitmap_bucket_number(value).alias("bucket"), F.bitmap_bit_position(value).alias("_bit")
    )
    return marked.groupBy(*map(quoted, by), "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def merge_bitmaps(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bitmaps of coarser groups: those of one bucket joined bit by bit."""
    return bitmaps.groupBy(*map(quoted, by), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact ``distinct_count`` of each group from its merged bitmaps."""
    return bitmaps.groupBy(*map(quoted, by)).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("distinct_count"))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, as one row."""
    return df.agg(F.count("*").alias("rows"))


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value, as one row."""
    return nan_to_null(df).agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def mean(df: DataFrame, column: str) -> DataFrame:
    """Mean over non-null values, as one row."""
    return nan_to_null(df).agg(F.avg(column).alias("mean_value"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows for each non-null value of a column."""
    known = nan_to_null(df).where(F.col(column).isNotNull())
    return known.groupBy(column).agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among the non-null ones.

    The total is a one-row scalar subquery over the counts, so neither side goes
    through an unpartitioned window.
    """
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, (F.col("n") / total).alias("share"))


def group_nonnull_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null count of every other column; groups with a null key are left out."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    return (
        nan_to_null(df)
        .na.drop("any", subset=keys)
        .groupBy(*keys)
        .agg(*[F.count(F.col(c)).alias(c) for c in others])
    )


def monthly_accounts(df: DataFrame, date_col: str = "account_creation_date") -> DataFrame:
    """Accounts opened in each (year, month)."""
    return (
        df.where(F.col(date_col).isNotNull())
        .groupBy(F.year(date_col).alias("year"), F.month(date_col).alias("month"))
        .agg(F.count("*").alias("accounts"))
    )


def group_sums(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum of each measure in each group."""
    return nan_to_null(df).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def group_mixed_agg(
    df: DataFrame, key: str, date_col: str, measures: Sequence[str]
) -> DataFrame:
    """First and last date and the sum of each measure, by key."""
    return nan_to_null(df).groupBy(key).agg(
        F.min(date_col).alias("date_min"),
        F.max(date_col).alias("date_max"),
        *[F.sum(m).alias(f"{m}_sum") for m in measures],
    )


def pivot_mean(
    df: DataFrame,
    index: str,
    values: dict[str, str],
    months: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Mean of some values by index (rows) and month (columns).

    ``months`` lists the (year, month) columns; left out, they are the months of the
    table, which are read first: one name for each group of output columns.
    ``values`` maps a value column to the prefix of its output columns: ``spend``
    gives ``spend_2019_07``.
    """
    if months is None:
        found = df.select("year", "month").dropna().distinct().collect()
        months = sorted((int(r["year"]), int(r["month"])) for r in found)
    month_key = F.format_string("%d_%02d", F.col("year").cast("int"), F.col("month").cast("int"))
    wanted = [f"{y}_{m:02d}" for y, m in months]
    pivoted = (
        df.withColumn("_ym", month_key)
        .groupBy(index)
        .pivot("_ym", wanted)
        .agg(*[F.avg(v).alias(prefix) for v, prefix in values.items()])
    )
    # Spark names a pivot column after its value alone if there is one aggregate.
    cells = []
    for ym in wanted:
        for prefix in values.values():
            source = ym if len(values) == 1 else f"{ym}_{prefix}"
            cells.append(F.col(f"`{source}`").alias(f"{prefix}_{ym}"))
    return pivoted.select(index, *cells)


# Double exponential quadrature over (0, infinity): points and weights.
_STEP = 0.05
_POINTS = [(math.exp(y - math.exp(-y)), _STEP * math.exp(y - math.exp(-y)) * (1 + math.exp(-y))) for y in (_STEP * k for k in range(-80, 95))]


def two_sided_p(r: Column, n: Column) -> Column:
    """P-value of a Pearson r on n rows against r = 0; null for fewer than three rows.

    With t = sqrt(df) sinh(w), Student's density is a power of 1 / cosh(w) and r the
    tanh of where the tail begins. The p-value is the tail's integral over that of the
    half line, which needs no other constant.
    """
    df, size = (n - 2).cast("double"), F.abs(r)
    points = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(w).alias("w")) for u, w in _POINTS])

    def tail(start: Column) -> Column:
        """The integral of (cosh(w + d) / cosh(w)) ** -df over d, where ``start`` is tanh(w)."""
        scale = 1 / (df * start + F.sqrt(df))

        def term(x: Column) -> Column:
            d = x["u"] * scale
            return x["w"] * scale * F.exp(-df * F.log1p(2 * F.pow(F.sinh(d / 2), 2) + start * F.sinh(d)))

        return F.aggregate(points, F.lit(0.0), lambda total, x: total + term(x))

    whole = F.exp(df / 2 * F.log1p(-size * size))
    p = F.least(F.lit(1.0), whole * tail(size) / tail(F.lit(0.0)))
    return F.when(F.isnan(r) | (n < 3), None).when(size >= 1, 0.0).otherwise(p)


def pearson_pairs(df: DataFrame, columns: Sequence[str], p_values: bool = False) -> DataFrame:
    """Pearson r of every ordered pair of different columns, over complete rows.

    One aggregate computes each unordered pair once; the result is then mirrored.
    ``p_values`` adds the row count and the two-sided p-value against r = 0.
    """
    pairs = list(combinations(columns, 2))
    stats = df.na.drop("any").agg(
        F.count("*").alias("n"), *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = [
        F.struct(
            F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"r{i}").alias("r"), F.col("n")
        )
        for i, (a, b) in enumerate(pairs)
        for x, y in ((a, b), (b, a))
    ]
    long = stats.select(F.inline(F.array(*rows)))
    if not p_values:
        return long.drop("n")
    return long.withColumn("p_value", two_sided_p(F.col("r"), F.col("n")))


def rate_of_distinct(part: DataFrame, whole: DataFrame, key: str = "subid") -> DataFrame:
    """Distinct keys of one table over those of another, as one row."""
    of_whole = whole.agg(F.count_distinct(key)).scalar()
    return part.agg(ratio(F.count_distinct(key), of_whole).alias("distinct_ratio"))
