"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its share, by weight, of all words; where that is above
``limit`` times its own size, it stops there and the excess goes to the others by
weight. Documents are dealt to shards of about ``docs_per_shard`` by a hash of the id
and the text, and the words of a source in a shard, in seeded order, are cut into
blocks of equal size (about ``block`` words). A shard is ordered in ``SLICES`` slices
by tasks of their own, each from where the slices before it end. The whole mix is apportioned in blocks: seats go
to the sources by highest quotients (target / 1, 3, 5, ...), then each source's
seats go to its shards the same way. A shard with n blocks and q seats takes each
block q div n times and q mod n of them once more; these are chosen by a seeded
permutation of the blocks.

The list of sources is configuration, as its weights are; the driver holds one row
for each source. Shards are handled by Spark.

Edge cases: a null source is a source of its own, last in order. A text without
words has size 0 and is not taken. A source of size 0 has target 0. Repeated rows
are separate documents of equal hash; they stand next to each other in the order.
Where only counts are asked for they are folded first and dealt out again at the end;
where texts are, those that are wholly equal lie in one slice. An empty table gives an
empty result. Extra columns are carried in ``row``.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subtide.llm.common import ragged_arange, sliced, word_count
from subtide.sources import materialize

LIMIT = 3
BLOCK = 64
DOCS_PER_SHARD = 20_000
SLICES = 64  # of a shard
COPIES = 10_000  # equal rows that a task writes in one go
SEED = 17
SLICE = 500  # documents cut at a time
CYCLE = (5, 2, 1)
_WORD = re.compile("[^ \\t-\\r]+")


def targets(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Each source's share of all words, none above ``limit`` times its size."""
    caps = [limit * s for s in sizes]
    found = [0.0] * len(sizes)
    rest, open_ = float(sum(sizes)), [i for i, s in enumerate(sizes) if s and weights[i]]
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if rest * weights[i] / total > caps[i]]
        if not above:
            for i in open_:
                found[i] = rest * weights[i] / total
            break
        for i in above:
            found[i] = float(caps[i])
        rest -= sum(caps[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return found


def apportion(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Sainte-Lague seats; no party above its cap, ties to the first.

    Rounding at one divisor gives an exact allocation for its own number of seats.
    From there seats are added by the highest next quotient, or taken back by the
    lowest last one, until the number is right.
    """
    weights, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    if not len(weights) or weights.sum() <= 0:
        return np.zeros(len(weights), np.int64)
    seats = min(int(seats), int(caps[weights > 0].sum()))
    given = np.minimum(np.floor(weights / weights.sum() * seats + 0.5).astype(np.int64), caps)
    extra = seats - int(given.sum())
    if extra > 0:
        heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, given, caps)) if g < c and w > 0]
    else:
        heap = [(w / (2 * g - 1), -i) for i, (w, g) in enumerate(zip(weights, given)) if g > 0]
    heapq.heapify(heap)
    step = 1 if extra > 0 else -1
    for _ in range(abs(extra)):
        i = abs(heap[0][1])
        given[i] += step
        if step > 0 and given[i] < caps[i]:
            heapq.heapreplace(heap, (-weights[i] / (2 * given[i] + 1), i))
        elif step < 0 and given[i] > 0:
            heapq.heapreplace(heap, (weights[i] / (2 * given[i] - 1), -i))
        else:
            heapq.heappop(heap)
    return given


def by_rank(sources: list[str | None]) -> list[float]:
    """Weights 5, 2, 1, repeating, over sources in order of code points, null last."""
    order = sorted(range(len(sources)), key=lambda i: (sources[i] is None, sources[i] or ""))
    found = [0.0] * len(sources)
    for rank, i in enumerate(order):
        found[i] = CYCLE[rank % len(CYCLE)]
    return found


def _measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``tie`` (a hash of the text), with the ``row``."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("tie"))


def _dealt(measured: DataFrame, n_docs: int, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Adds ``key``, ``shard``, ``slice`` and ``place`` (order in a slice); ``times`` is how often a row counts."""
    shards = math.ceil(max(1, n_docs) / docs_per_shard)
    hashed = F.xxhash64(F.col("doc_id"), F.col("tie"), F.lit(SEED))
    place = F.xxhash64(hashed)
    return measured.select(
        "*",
        *([] if "times" in measured.columns else [F.lit(1).cast("long").alias("times")]),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
        F.pmod(hashed, F.lit(shards)).alias("shard"),
        F.pmod(place, F.lit(SLICES)).alias("slice"),
        place.alias("place"),
    )


def _seats_by_shard(seed: int, limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Deals one source's seats to its shards and draws each shard's permutation."""

    def deal(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard").reset_index(drop=True)
        n = shards.blocks.to_numpy(np.int64)
        seats = apportion(n, int(shards.seats[0]), n * limit)
        steps, starts = [], []
        for shard, blocks in zip(shards.shard, n):
            rng = np.random.default_rng([seed, *shards.key[0].encode(), int(shard)])
            step = int(rng.integers(1, max(2, blocks)))
            while blocks and math.gcd(step, int(blocks)) != 1:
                step += 1
            steps.append(step)
            starts.append(int(rng.integers(0, max(1, blocks))))
        return shards[["key", "shard", "words", "blocks", "source_size", "target"]].assign(seats=seats, step=steps, start=starts)

    return deal


def plan(
    docs: DataFrame,
    weights: Callable[[list[str | None]], list[float]] = by_rank,
    block: int = BLOCK,
    limit: int = LIMIT,
    seed: int = SEED,
) -> DataFrame:
    """For the rows of :func:`_dealt`: where each document lies in its shard, and the shard's seats."""
    words = F.col("size") * F.col("times")
    ends = docs.groupBy("key", "shard", "slice").agg(F.sum(words).alias("slice_words"), F.first("source").alias("source"))
    slices = materialize(ends, "mix-slices")
    shards = slices.groupBy("key", "shard").agg(F.sum("slice_words").alias("words"), F.first("source").alias("source"))
    even = F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long")
    shards = shards.withColumn("blocks", F.when(F.col("words") > 0, even).otherwise(0))
    sources = shards.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("words"), F.sum("blocks").alias("blocks")).collect()
    sources = sorted(sources, key=lambda r: (r.source is None, r.source or ""))
    found = targets([r.words for r in sources], weights([r.source for r in sources]), limit)
    rates = [t / r.words * r.blocks if r.words else 0.0 for t, r in zip(found, sources)]
    seats = apportion(np.array(rates), round(sum(rates)), np.array([r.blocks * limit for r in sources], np.int64))
    rows = [(r.key, int(r.words), float(t), int(q)) for r, t, q in zip(sources, found, seats)]
    quotas = docs.sparkSession.createDataFrame(rows, "key string, source_size long, target double, seats long")
    dealt = shards.join(quotas, "key").groupBy("key").applyInPandas(
        _seats_by_shard(seed, limit),
        "key string, shard long, words long, blocks long, source_size long, target double, seats long, step long, start long",
    )
    lower = Window.partitionBy("key", "shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = slices.select("key", "shard", "slice", F.coalesce(F.sum("slice_words").over(lower), F.lit(0)).alias("begin"))
    order = Window.partitionBy("key", "shard", "slice").orderBy("place", "doc_id", "size", "tie")
    within = F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - words
    found = docs.withColumn("within", within).join(materialize(begins.join(dealt, ["key", "shard"]), "mix-seats"), ["key", "shard", "slice"])
    return found.withColumn("before", F.col("begin") + F.col("within"))


def _pieces(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The parts of blocks that the documents lie in: document, length, copies."""
    size, before, words, n = (pdf[c].to_numpy(np.int64) for c in ("size", "before", "words", "blocks"))
    some = np.flatnonzero(size > 0)
    t, b = words[some], n[some]
    first = ((before[some] + 1) * b - 1) // t
    last = ((before[some] + size[some]) * b - 1) // t
    count = last - first + 1
    doc = np.repeat(some, count)
    block = np.repeat(first, count) + ragged_arange(count)
    lo = np.maximum(block * words[doc] // n[doc], before[doc])
    hi = np.minimum((block + 1) * words[doc] // n[doc], before[doc] + size[doc])
    seats, step, start = (pdf[c].to_numpy(np.int64)[doc] for c in ("seats", "step", "start"))
    chosen = (block * step + start) % n[doc] < seats % n[doc]
    return doc, hi - lo, seats // n[doc] + chosen


def taken(planned: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, the words of it that the mix has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, length, copies = _pieces(batch.select(needed).to_pandas())
            words = np.bincount(doc, length * copies, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select(given).columns, pa.array(words)], names=[*given, "taken"])

    given = ["doc_id", "size", "source_size", "target"]
    needed = ["size", "before", "words", "blocks", "seats", "step", "start"]
    schema = "doc_id long, size long, source_size long, target double, taken long"
    return planned.select(*given, *needed[1:]).mapInArrow(count, schema)


def render(text: str, lengths: np.ndarray, copies: np.ndarray) -> list[str]:
    """The texts of the first, second, ... copy: runs of taken words as they stand in the text, one a line."""
    if (copies == copies[0]).all():
        return [text] * int(copies[0])
    at = np.array([m.span() for m in _WORD.finditer(text)])
    ends = np.cumsum(lengths)
    found = []
    for level in range(1, int(copies.max()) + 1):
        edges = np.diff(np.concatenate([[0], (copies >= level).astype(np.int8), [0]]))
        runs = zip((ends - lengths)[np.flatnonzero(edges > 0)], ends[np.flatnonzero(edges < 0) - 1])
        found.append("\n".join(text[at[a, 0] : at[b - 1, 1]] for a, b in runs))
    return found


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``docs``: one row for each copy of a document, cut to the taken words.

    ``n_chars``, if there is one, is counted anew.
    """
    planned = plan(_dealt(_measured(docs), docs.count())).select("row", "size", "before", "words", "blocks", "seats", "step", "start")
    types = planned.select("row.*").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            doc, length, copies = _pieces(batch.select(needed).to_pandas())
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            rows = batch.column("row")
            out = []
            for i in np.unique(doc).tolist():
                part, row = slice(ends[i], ends[i + 1]), rows[i].as_py()
                for text in render(row["text"], length[part], copies[part]):
                    out.append({**row, "text": text} | ({"n_chars": len(text)} if "n_chars" in row else {}))
            columns = [pa.array([r[f.name] for r in out], f.type) for f in rows.type]
            yield pa.RecordBatch.from_arrays(columns, names=types.names)

    needed = ["size", "before", "words", "blocks", "seats", "step", "start"]
    return planned.mapInArrow(cut, types)


def _each(planned: DataFrame, copies: int = COPIES) -> DataFrame:
    """A row for each of the equal rows that were folded, at most ``copies`` of them to a task at a time."""
    begin, step = F.col("from_copy"), F.lit(copies).cast("long")
    chunks = planned.withColumn("from_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, step)))
    chunks = chunks.repartition("doc_id", "tie", "from_copy")
    each = chunks.withColumn("copy", F.explode(F.sequence(begin, F.least("times", begin + step) - 1)))
    return each.withColumn("before", F.col("before") + F.col("copy") * F.col("size"))


def mix_counts(docs: DataFrame, docs_per_shard: int = DOCS_PER_SHARD, copies: int = COPIES) -> DataFrame:
    """:func:`taken` of all documents; equal rows are folded, and the sizes stored once."""
    folded = _measured(docs.select("doc_id", "text", "source")).groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("times"))
    planned = plan(_dealt(materialize(folded, "mix-sizes"), docs.count(), docs_per_shard))
    return taken(_each(planned, copies))
