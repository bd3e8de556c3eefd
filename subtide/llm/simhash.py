"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Fingerprints within ``radius`` bits are linked, and
groups are the connected components. For radius r there are 2^(r+1) - 1 tables.
Every bit is given a nonzero vector of r+1 bits; the mask of table v keeps the bits
whose vector has an odd product with v. The vectors of any r bits span less than the
whole space, so some v is orthogonal to all of them, and the mask of that table
leaves exactly those bits out: each pair within the radius meets in that table.

Rows are grouped by fingerprint first, so a group of copies is one row. Buckets of
one fingerprint are dropped. A large bucket is not compared pair by pair: each of its
fingerprints sends out all values it has with up to r/2 of the bits outside the mask
flipped. Two fingerprints within two bits share such a value, and all that share one
are within two bits of each other, so the smallest stands for the links of all. No
group of such a value has over 65 fingerprints, whatever the data.

Edge cases: a null or empty text has the fingerprint zero and is linked like any
other. Repeated rows have one component. A null doc_id takes part, but is not taken
as the smallest while the component has another. An empty table gives an empty
result. Extra columns are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from subtide.llm.common import salted_join
from subtide.llm.components import connected_components
from subtide.sources import materialize

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    columns = [words[i : len(words) - shingle + 1 + i] for i in range(shingle)]
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*columns))), "<u8")
    votes = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 8192 + 1):
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    over = votes * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with ``fp``, the fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(signed)], names=[*names, "fp"])

    names = ["row", "doc_id"] if "row" in docs.columns else ["doc_id"]
    given = docs.select(*names, "text")
    types = {f.name: f.dataType for f in given.schema.fields}
    schema = ", ".join(f"{n} {types[n].simpleString()}" for n in names) + ", fp long"
    return given.mapInArrow(of, schema)


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks; any two values within the radius agree under one of them."""
    size = 2 ** (radius + 1) - 1
    vector = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``u``, ``v`` that connect exactly the fingerprints ``fp`` linked within the radius."""
    if radius not in (1, 2):
        raise ValueError("the radius is 1 or 2")
    kept = masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for t, m in enumerate(kept)])
    dealt = distinct.select("fp", F.explode(tables).alias("b")).select("fp", "b.table", "b.key")
    # A bucket counts if it has two fingerprints; two numbers a bucket tell that.
    shared = dealt.groupBy("table", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    members = salted_join(dealt, shared.select("table", "key"), ["table", "key"], F.col("fp"))
    flips = [F.array(*[F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]]) for m in kept]
    near = F.explode(F.get(F.array(*flips), F.col("table")))
    values = members.select("fp", near.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    if radius == 1:
        # A value with one bit flipped that is a fingerprint itself is a link.
        met = values.join(distinct.select(F.col("fp").alias("value")), "value").filter("fp > value")
        return met.select(F.col("fp").alias("u"), F.col("value").alias("v")).distinct()
    least = Window.partitionBy("value")
    found = values.select("fp", F.min("fp").over(least).alias("least")).filter("fp <> least")
    return found.select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def components(stored: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp``, its component's ``root`` and ``component_id``, the smallest doc_id in it; one row for each ``fp``."""
    distinct = materialize(stored.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    roots = connected_components(links(distinct, radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left")
    rooted = rooted.select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = salted_join(rooted, smallest, ["root"], F.col("fp")).select("fp", "root", "component_id")
    return materialize(found, "simhash-components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for each row."""
    stored = materialize(fingerprints(docs.select("doc_id", "text"), shingle), "simhash")
    found = salted_join(stored, components(stored, radius), ["fp"], F.coalesce("doc_id", F.lit(0)))
    return found.select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, with its own columns: that of the smallest doc_id, or one of those.

    Rows get a stored number, by which the one that stays is fetched, so texts are
    shuffled once.
    """
    carried = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    numbered = fingerprints(carried, shingle).withColumn("n", F.monotonically_increasing_id())
    stored = materialize(numbered, "simhash-rows")
    of = components(stored.select("doc_id", "fp"), radius)
    named = salted_join(stored.select("doc_id", "fp", "n"), of, ["fp"], F.col("n"))
    first = named.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("root").agg(F.min("n").alias("n")).select("n")
    return stored.join(kept, "n").select("row.*")
