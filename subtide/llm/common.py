"""What several operators of this folder share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the contracts: the blank and the control characters 09 to 0D.
SPACE = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    """Number of words of a text (null: 0), as long."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, salts: int = 8) -> DataFrame:
    """Inner join to a right side of one row for each key, each key dealt to ``salts`` tasks.

    ``spread`` is any value of the left rows that differs within a key. The right
    rows are repeated ``salts`` times, so a hot key of the left side is split.
    """
    salted = left.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    numbers = F.array(*[F.lit(i).cast("long") for i in range(salts)])
    repeated = right.withColumn("salt", F.explode(numbers))
    return salted.join(repeated, [*on, "salt"]).drop("salt")


def many_salts(spark: SparkSession) -> int:
    """Salts for keys that may hold a large part of all rows: the root of the shuffle partitions, 8 at least."""
    return max(8, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ragged_arange(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most some rows, to bound what a task holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
