"""Packing documents into sequences by shortest-pack-first over the length histogram.

A document's token ids, with the end id after them, are cut into full pieces of
``capacity`` and a rest. The histogram of piece lengths has at most ``capacity``
entries, so packing it is driver work of fixed size, whatever the number of
documents. Lengths are placed longest first. Packs are not kept one by one but as
patterns (tuples of lengths) with counts; a length goes to the patterns that are
filled least, and what does not fit there opens new packs. Patterns then meet their
documents by rank: pieces of one length are numbered, and each slot of a pattern
takes as many numbers as the pattern has packs.

Ids equal those of the ``tokenizers`` library. The faster encoder of the same
vocabulary is used, except for texts with a special token's string, or with a run of
white space of ``LONG_RUN`` characters, which that encoder's pattern can't take.

Edge cases: a null or empty text is one piece with the end id only. Repeated rows
are packed once each. Ties in length are numbered by a hash of the id, then start.
An empty table gives no sequences. Extra columns are not carried.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subtide.llm.common import sliced
from subtide.sources import materialize

CAPACITY = 2048
END = 1
SLICE = 500  # documents encoded at a time
VOCABULARY = "byte_bpe_50k"
LONG_RUN = 100_000
_RUNS = re.compile(r"\s{100,}")


def has_long_run(text: str) -> bool:
    """Whether white space runs on for ``LONG_RUN`` characters; in time proportional to the text."""
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in _RUNS.finditer(text))


def encoder(vocabulary: str = VOCABULARY, plain_specials: bool = False) -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids, as ``tokenizers`` gives them without special tokens added.

    With ``plain_specials`` the strings of special tokens in a text are ordinary text.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path(f"{vocabulary}.json")
    with open(path, encoding="utf-8") as file:
        special = [] if plain_specials else [t["content"] for t in json.load(file)["added_tokens"]]
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @lru_cache
    def full() -> Tokenizer:  # few texts need it
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain_specials
        return tokenizer

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            full().encode(t, add_special_tokens=False).ids if has_long_run(t) or any(s in t for s in special) else fast.encode_ordinary(t)
            for t in texts
        ]

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each row's pieces: ``n`` (a number for the row), ``start``, ``length``, the digest and, if asked for, ``ids``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in sliced(batches, SLICE):
            texts = batch.column("text").fill_null("").to_pylist()
            rows, out = [], []
            for row, found in enumerate(encode(texts)):
                ids = np.array([*found, END], "<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity].tobytes()
                    rows.append(row)
                    out.append((start, len(part) // 4, zlib.crc32(part), len(ids), part))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)]
            given = batch.select(["doc_id", "n"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*given.columns, *columns][: len(names)], names=names)

    names = ["doc_id", "n", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    types = [pa.int64()] * 4 + [pa.binary()]
    schema = "doc_id long, n long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("n"))
    return numbered.mapInArrow(of, schema)


def pack_histogram(lengths: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Patterns of lengths, longest first, and how many packs follow each."""
    packs: Counter = Counter()
    open_: dict[int, Counter] = defaultdict(Counter)  # patterns by what they hold
    fills: list[int] = []
    for length, count in sorted(lengths.items(), reverse=True):
        placed: list[tuple[tuple[int, ...], int]] = []
        while count:
            while fills and not open_.get(fills[0]):
                open_.pop(heapq.heappop(fills), None)
            if not fills or fills[0] + length > capacity:
                placed.append(((length,), count))
                break
            pattern, have = open_[fills[0]].popitem()
            used = min(have, count)
            if have > used:
                open_[fills[0]][pattern] = have - used
            placed.append(((*pattern, length), used))
            count -= used
        for pattern, used in placed:
            fill = sum(pattern)
            if fill == capacity:
                packs[pattern] += used
                continue
            if fill not in open_:
                heapq.heappush(fills, fill)
            open_[fill][pattern] += used
    for patterns in open_.values():
        packs.update(patterns)
    return packs


def _slots(packs: Counter) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: where each slot's ranks begin, its first sequence and its offset."""
    taken: Counter = Counter()
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, count in sorted(packs.items()):
        offset = 0
        for length in pattern:
            found[length].append((taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return {k: tuple(np.array(v, np.int64).T) for k, v in found.items()}


def _place(slots, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of each piece, by its rank among those of its length."""
    sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
    for length in np.unique(lengths):
        mine = np.flatnonzero(lengths == length)
        begin, first, at = slots[int(length)]
        slot = np.searchsorted(begin, ranks[mine], "right") - 1
        sequence[mine], offset[mine] = first[slot] + ranks[mine] - begin[slot], at[slot]
    return sequence, offset


def _ranked(stored: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Numbers the pieces of each length from 0; a length's pieces are numbered in as many slices as a slice has pieces."""
    slices = F.array(*[F.lit(math.isqrt(counts.get(length, 0)) + 1) for length in range(max(counts, default=0) + 1)])
    hashed = stored.withColumn("slice", F.pmod(F.xxhash64("n", "start"), F.get(slices, F.col("length").cast("int"))))
    found = hashed.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = found.select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "slice").orderBy("n", "start")
    ranked = hashed.withColumn("at", (F.row_number().over(order) - 1).cast("long")).join(base, ["length", "slice"])
    return ranked.withColumn("rank", F.col("base") + F.col("at")).drop("slice", "at", "base")


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: its document, place in it, length, digest and place in a sequence."""
    stored = materialize(pieces(docs, capacity, with_ids), "packing")
    counts = {r["length"]: r["count"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("count")).collect()}
    slots = _slots(pack_histogram(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            where = [pa.array(c) for c in _place(slots, lengths, ranks)]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *where], names=[*kept, "sequence_id", "offset"])

    kept = [c for c in stored.columns if c != "n"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return _ranked(stored, counts).select(*kept, "rank").mapInArrow(place, schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = END) -> DataFrame:
    """``sequence_id`` and ``ids``, padded to the capacity unless their number is a power of two; needs ``ids``."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filler = np.uint32(pad).astype("<u4").tobytes()
        for pdf in batches:
            made = []
            for parts in pdf.parts:
                ids = b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"]))
                n = len(ids) // 4
                made.append(ids + filler * (capacity - n if n & (n - 1) else 0))
            yield pd.DataFrame({"sequence_id": pdf.sequence_id, "ids": made})

    grouped = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts"))
    return grouped.mapInPandas(join, "sequence_id long, ids binary")
