"""Model inputs: feature choice, dummy columns and the train/test split."""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.functions import u01
from subtide.operators.ordering import in_ranges, running_sums
from subtide.operators.profile import quoted
from subtide.operators.relational import lookup_join
from subtide.sources import materialize

# The most columns that an encoded table gets.
MOST_LEVELS = 10_000

# Modelling-table columns that are not features.
NOT_FEATURES = (
    "subid",
    "churn",
    "join_fee",
    "payment_period",
    "attribution_technical",
    "month",
    "year",
    "refund_after_trial_tf",
    "monthly_price",
    "account_creation_date",
)
# Categorical features.
CATEGORICAL = (
    "package_type",
    "preferred_genre",
    "intended_use",
    "male_tf",
    "op_sys",
    "plan_type",
    "payment_type",
)


def feature_columns(df: DataFrame, excluded: Sequence[str] = NOT_FEATURES) -> list[str]:
    """All columns except the excluded ones."""
    return [c for c in df.columns if c not in excluded]


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted non-null levels of text or flag columns, found in one pass.

    As many are read as the encoded table has columns; over ``MOST_LEVELS`` raise, as
    :func:`sparse_encode` is the form for those.
    """
    seen = _cells(df, columns).select("column", "level").distinct()
    rows = seen.limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"over {MOST_LEVELS} levels in {list(columns)}: use sparse_encode")
    return {c: sorted(r["level"] for r in rows if r["column"] == c) for c in columns}


def _cells(df: DataFrame, columns: Sequence[str], *carry: str) -> DataFrame:
    """One row for each non-null category of a row: its column's place and name, and the level as text."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType)):
            raise ValueError(f"{c!r} is neither text nor flag")
    cells = [
        F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("level"))
        for i, c in enumerate(columns)
    ]
    return df.select(*carry, F.inline(F.array(*cells))).where("level IS NOT NULL")


def category_dictionary(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """``place``, ``column``, ``level`` and ``at``, the level's place in an encoded vector, stored.

    Places follow the columns, then the levels' order. The first level of a column
    has none. Levels are numbered in ranges, so no task and no driver has them all.
    """
    seen = _cells(df, columns).distinct()
    numbered = running_sums(in_ranges(seen.withColumn("one", F.lit(1)), ["place", "level"], "levels"), ["place", "level"], {"number": "one"})
    firsts = seen.groupBy("place").agg(F.min("level").alias("first"))
    # One row for each column: how many first levels there are up to it.
    upto = firsts.withColumn("left_out", F.count("*").over(Window.orderBy("place")))
    at = F.when(F.col("level") != F.col("first"), F.col("number") - 1 - F.col("left_out"))
    found = numbered.join(F.broadcast(upto), "place").select("place", "column", "level", at.alias("at"))
    return materialize(found, "dictionary")


def sparse_encode(
    df: DataFrame,
    columns: Sequence[str] = CATEGORICAL,
    dictionary: DataFrame | None = None,
    output: str = "categories",
) -> DataFrame:
    """Replace categories by one sparse vector, for columns of any number of levels.

    The vector has the 0/1 columns of :func:`dummy_encode` in the same order. A null,
    a first level and one that ``dictionary`` does not have are 0 everywhere. Rows are
    numbered and stored; their categories are joined to the dictionary, with hot levels
    split, and come back as at most one entry for each column.
    """
    dictionary = category_dictionary(df, columns) if dictionary is None else dictionary
    stored = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "unencoded")
    known = dictionary.select("place", "level", "at").where("at IS NOT NULL")
    cells = _cells(stored, columns, "_row").drop("column")
    found = lookup_join(cells, known, ["place", "level"], "_row").where("at IS NOT NULL")
    entries = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.col("at").cast("int"))).alias("indices"))
    size = dictionary.agg(F.count("at").cast("int")).scalar()
    indices = F.coalesce("indices", F.array().cast("array<int>"))
    # A sparse vector as its stored struct, read back as a vector.
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"),
        size.alias("size"),
        indices.alias("indices"),
        F.transform(indices, lambda _: F.lit(1.0)).alias("values"),
    )
    kept = [c for c in df.columns if c not in columns]
    flat = stored.join(entries, "_row", "left").select(*map(quoted, kept), vector.alias(output))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(output, VectorUDT())])
    return materialize(flat, "encoded", read_as=schema)


def dummy_name(column: str, level: str) -> str:
    """Column name of a level, in lower snake case; letters of all scripts stay."""
    return f"{column}_{re.sub(r'[\W_]+', '_', level.lower()).strip('_')}"


def dummy_names(column: str, levels: Sequence[str], taken: Collection[str] = ()) -> dict[str, str]:
    """The column names of levels; where two would meet, a level's place in the order is added."""
    plain = [dummy_name(column, level) for level in levels]
    names: dict[str, str] = {}
    for i, (level, name) in enumerate(zip(levels, plain)):
        unique = plain.count(name) == 1 and name not in taken
        while not unique:
            name += f"_{i}"
            unique = name not in taken and name not in plain and name not in names.values()
        names[level] = name
    return names


def dummy_encode(
    df: DataFrame,
    columns: Sequence[str] = CATEGORICAL,
    levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Replace categories by 0/1 columns, leaving out each one's first level.

    A null, like the first level, is 0 in all of a column's dummies. ``levels``
    fixes the levels, for example to encode new rows like the training rows.
    """
    levels = category_levels(df, columns) if levels is None else levels
    dummies = {}
    for c in columns:
        names = dummy_names(c, levels[c], {*dummies, *df.columns})
        for level in levels[c][1:]:
            name = names[level]
            is_level = F.col(c).cast("string") == F.lit(level)
            dummies[name] = F.when(is_level, 1).otherwise(0)
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *[v.alias(n) for n, v in dummies.items()])


def with_split(df: DataFrame, key: str = "subid", train_share: float = 0.7) -> DataFrame:
    """Add ``is_train``, drawn from the key: stable under retries and repartitioning."""
    return df.withColumn("is_train", u01(key, "split") < F.lit(train_share))


def train_test_split(
    df: DataFrame, key: str = "subid", train_share: float = 0.7
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; all rows of a key are on the same side."""
    marked = with_split(df, key, train_share)
    train = marked.where(F.col("is_train")).drop("is_train")
    return train, marked.where(~F.col("is_train")).drop("is_train")
