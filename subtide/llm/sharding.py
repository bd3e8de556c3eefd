"""Sharding by extendible hashing.

A document belongs to the bucket named by the leading bits of a hash of its id. The
directory starts with one bucket; a bucket above the byte limit is split on its next
bit, others stay as they are, until every bucket fits. Splitting works on a histogram
of bytes by leading bits, which is stored for ``STEP`` bits at a time: only the
documents of buckets that are still too large are read for the next bits.

Documents of one and the same hash cannot be split by bits. If their bucket is above
the limit, it gets overflow pages, filled in order of the text's hash. A document
that is larger than the limit by itself has a page of its own and is marked.

Edge cases: a null text has 0 bytes. A null id has a hash like any other value.
Repeated rows share a hash, so a large group of them is dealt to overflow pages.
An empty table has no shards. Extra columns are carried in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.llm.common import many_salts, salted_join
from subtide.sources import materialize

LIMIT = 32 << 20
STEP = 8
BITS = 60
PAGED_LIMITS, PAGED_DOCS = 16, 100_000  # what a task pages in one go: so many limits of bytes, or documents


def hash_bits(col: str) -> Column:
    """60 bits of the id's md5, as text of 0 and 1."""
    key = F.coalesce(F.col(col).cast("string"), F.lit("null"))
    number = F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 2)
    return F.lpad(number, BITS, "0")


def directory(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``prefix``, ``depth``, ``bytes`` and ``docs`` of each bucket; ``sizes`` has ``bits``, ``n_bytes`` and a row number ``n``."""
    done = None
    level = 0
    rest = sizes.select("bits", "n_bytes").withColumn("prefix", F.lit(""))
    while True:
        wide = F.substring("bits", 1, level + STEP)
        fine = materialize(rest.groupBy("prefix", wide.alias("wide")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("bits").alias("lo"), F.max("bits").alias("hi")), "shard-bytes")
        # Every prefix of each wide one with its bytes; a bucket is the shortest prefix that fits.
        depths = F.explode(F.sequence(F.lit(level), F.lit(level + STEP)))
        nodes = fine.select("wide", "bytes", "docs", "lo", "hi", depths.alias("depth")).withColumn("node", F.expr("substring(wide, 1, depth)"))
        nodes = nodes.groupBy("depth", "node").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("up"), (_fits(limit)).alias("up_fits"))
        with_parent = nodes.withColumn("up", F.expr("substring(node, 1, depth - 1)")).join(parent, ["depth", "up"], "left")
        with_parent = materialize(with_parent.filter(F.coalesce(~F.col("up_fits"), F.lit(True))), "shard-nodes")
        fits = with_parent.filter(_fits(limit)).select(F.col("node").alias("prefix"), "depth", "bytes", "docs")
        done = fits if done is None else done.union(fits)
        level += STEP
        large = with_parent.filter(~_fits(limit) & (F.col("depth") == level)).select(F.col("node").alias("prefix"))
        if level >= BITS or large.isEmpty():
            return done
        rest = salted_join(sizes.select("bits", "n_bytes", "n").withColumn("prefix", F.substring("bits", 1, level)), large, ["prefix"], F.col("n"), many_salts(sizes.sparkSession))


def _fits(limit: int) -> Column:
    """Within the limit, or of one hash only, which more bits do not split."""
    return (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))


def _with_bucket(sizes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each document's bucket: the depths in use are few, one equality each."""
    depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())
    named = sizes.select("*", F.explode(F.array(*[F.lit(d) for d in depths])).alias("at") if depths else F.lit(0).alias("at"))
    named = named.withColumn("prefix", F.expr("substring(bits, 1, at)"))
    of = buckets.select("prefix", F.col("depth").alias("at"), F.col("bytes").alias("bucket_bytes"), F.col("docs").alias("bucket_docs"))
    return salted_join(named, of, ["prefix", "at"], F.col("n"), many_salts(sizes.sparkSession)).withColumnRenamed("at", "depth")


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, its shard (``prefix``, ``page``) with the shard's size, and whether it is alone too large."""
    return _assigned(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("n")), limit).drop("n")


def _assigned(numbered: DataFrame, limit: int) -> DataFrame:
    """:func:`assign` for rows that have a number ``n``, which is carried along."""
    sizes = materialize(numbered.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64("text").alias("tie"), "n", hash_bits("doc_id").alias("bits")), "shard-sizes")
    buckets = materialize(directory(sizes, limit), "shard-directory")
    placed = _with_bucket(sizes, buckets)
    over = placed.filter(F.col("bucket_bytes") > limit)
    return _sized_shards(placed.filter(F.col("bucket_bytes") <= limit).withColumn("page", F.lit(0).cast("long")).unionByName(_pages(over, limit)), limit)


def _pages(over: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of buckets of one hash.

    The documents are dealt to slices by their stored number, as many as the bucket's
    bytes and documents ask; each slice fills pages of its own, so no task has all of a
    bucket. A page takes documents whose running
    sum begins in the same half of the limit and ends within it; one above half the
    limit has a page of its own.
    """
    half = limit // 2
    slices = F.ceil(F.greatest(F.col("bucket_bytes") / (PAGED_LIMITS * limit), F.col("bucket_docs") / PAGED_DOCS))
    sliced = over.withColumn("slice", F.pmod(F.xxhash64("n"), slices))
    sliced = sliced.withColumn("big", F.col("n_bytes") > half)
    order = Window.partitionBy("prefix", "slice", "big").orderBy("tie", "n")
    run = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_bytes")
    number = F.when(F.col("big"), F.row_number().over(order)).otherwise(F.floor(run / half))
    page = (F.col("slice") * 2 + F.col("big").cast("long")) * F.lit(1 << 40) + number
    return sliced.withColumn("page", page.cast("long")).select(*over.columns, "page")


def _sized_shards(placed: DataFrame, limit: int) -> DataFrame:
    kept = placed.select("n", "doc_id", "n_bytes", "prefix", "depth", "page")
    kept = materialize(kept, "shard-places")
    total = kept.groupBy("prefix", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    named = salted_join(kept, total, ["prefix", "page"], F.col("n"), many_salts(placed.sparkSession))
    return named.withColumn("oversize", F.col("n_bytes") > limit)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the rows of ``docs`` as Parquet, one folder for each shard.

    Rows are stored with a number, by which each finds its own shard: those of one id
    may lie in several.
    """
    carried = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.monotonically_increasing_id().alias("n"))
    stored = materialize(carried, "shard-rows")
    shard = F.concat_ws("-", F.concat(F.lit("b"), "prefix"), "page").alias("shard")
    shards = _assigned(stored.select("doc_id", "text", "n"), limit).select("n", shard)
    joined = stored.select("row", "n").join(shards, "n").select("row.*", "shard")
    joined.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
