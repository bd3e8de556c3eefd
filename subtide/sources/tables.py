"""Table readers and writers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table; column pruning and filters reach its scan."""
    return spark.read.parquet(path)


def load_spend_csv(
    spark: SparkSession, path: str, date_col: str = "date", date_format: str | None = None
) -> DataFrame:
    """Read a wide spend CSV: a date and one money column for each channel.

    Money is text with ``,`` between thousands. Every column is read as text
    (no inference pass over the data), the separators are taken out and the rest
    cast to double; text that is still no number raises. The date becomes
    ``year`` and ``month``; ``date_format`` is a pattern such as ``M/d/yyyy``, ISO
    dates need none.
    """
    raw = spark.read.csv(path, header=True)
    channels = [c for c in raw.columns if c != date_col]
    money = [_number(c).cast("double").alias(c) for c in channels]
    day = F.to_date(F.col(date_col), date_format)
    return raw.select(F.year(day).alias("year"), F.month(day).alias("month"), *money)


def _number(column: str) -> Column:
    """The text of a cell without separators of thousands."""
    return F.translate(F.col(f"`{column}`"), ",", "")


def split_spend_csv(
    spark: SparkSession, path: str, date_col: str = "date", date_format: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of a wide spend CSV as :func:`load_spend_csv` gives them, and its rejects.

    A record is rejected whole if its date or an amount can't be read, or if it has
    more or fewer cells than the header. Rejects have the record's text (``record``)
    and the columns at fault (``bad_columns``, empty if the number of cells is).
    Empty cells are unknown amounts, an empty date is at fault.
    """
    header = spark.read.csv(path, header=True).columns
    channels = [c for c in header if c != date_col]
    broken = "_broken_record"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, broken]])
    raw = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=broken)
    day = F.expr(f"try_to_date(`{date_col}`{'' if date_format is None else ', ' + repr(date_format)})")
    unread = [F.when(day.isNull(), F.lit(date_col))]
    unread += [F.when(F.col(f"`{c}`").isNotNull() & _number(c).try_cast("double").isNull(), F.lit(c)) for c in channels]
    bad = F.when(F.col(broken).isNull(), F.array_compact(F.array(*unread))).otherwise(F.array().cast("array<string>"))
    marked = raw.withColumns({"_bad": bad, "_day": day})
    is_bad = (F.size("_bad") > 0) | F.col(broken).isNotNull()
    text = F.coalesce(F.col(broken), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in header])))
    money = [_number(c).try_cast("double").alias(c) for c in channels]
    rows = marked.where(~is_bad).select(F.year("_day").alias("year"), F.month("_day").alias("month"), *money)
    return rows, marked.where(is_bad).select(text.alias("record"), F.col("_bad").alias("bad_columns"))


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV part files with a header line."""
    df.write.mode("overwrite").csv(path, header=True)


# Paths of stored tables by application, each with the scope it belongs to.
_STORED: dict[str, dict[str, object]] = {}
_SCOPE: ContextVar[object] = ContextVar("subtide_scope", default=None)


def checkpoint_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), read_as: T.StructType | None = None
) -> DataFrame:
    """Write a table as Parquet and return a reader of what was written.

    The reader has no lineage behind it and, unlike a cached frame, outlives
    lost executors. Its file sizes also give the optimizer true statistics.
    ``read_as`` names other types of the same stored form.
    """
    df.write.mode("overwrite").parquet(path, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(read_as or df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="subtide-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(
    df: DataFrame, name: str, partition_by: Sequence[str] = (), read_as: T.StructType | None = None
) -> DataFrame:
    """:func:`checkpoint_table` under a fresh name in the shared folder.

    The table stays until the :func:`scope` around it ends, :func:`release` is called
    on what comes back, or :func:`release_all` for the whole session.
    """
    return checkpoint_table(df, scratch_path(df.sparkSession, name), partition_by, read_as)


def store_by_key(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """:func:`materialize` in buckets by ``keys``, each sorted by them.

    Tables stored in equally many buckets join on the keys, and are grouped by them,
    without a shuffle, however often that is done. Left out, ``buckets`` is the number
    of shuffle partitions. All rows of a key lie in one bucket, so a key with a large
    share of the rows has to be kept elsewhere.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = _table_name(path)
    # One task and one file for each bucket; no shuffle where the rows lie like that already.
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def _table_name(path: str) -> str:
    """The catalog's name of a bucketed table, by the path that it is stored under."""
    return "subtide_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, registered for deletion before anything is written."""
    path = f"{shared_folder(spark)}/subtide/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, {})[path] = _SCOPE.get()
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving all that was stored within, also what a failed job left half written.

    Results must be read or written elsewhere inside. Scopes may be nested or run in
    several threads; each has what its own thread stored in it.
    """
    mark = object()
    token = _SCOPE.set(mark)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        own = _STORED.get(spark.sparkContext.applicationId, {})
        for path in [p for p, of in own.items() if of is mark]:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path of :func:`scratch_path`."""
    _delete(spark, path)
    _STORED.get(spark.sparkContext.applicationId, {}).pop(path, None)


def release(stored: DataFrame) -> None:
    """Delete the files behind tables that :func:`materialize` wrote and that ``stored`` reads."""
    own = _STORED.get(stored.sparkSession.sparkContext.applicationId, {})
    read = stored.inputFiles()
    for path in [p for p in own if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in read)]:
        delete_path(stored.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete all that was stored in this session."""
    for path in _STORED.pop(spark.sparkContext.applicationId, {}):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
