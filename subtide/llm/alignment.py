"""Alignment of two tokenizers' tokens by the bytes they stand for.

A text's tokens of both kinds are intervals of its bytes. Sorted by start, with the
running maximum of the ends, a group breaks where a start reaches that maximum: there
tokens of both kinds end. Within a group tokens overlap. Two tokens are linked if they
end together.

Texts are cut at single blanks between characters that are no white space. Neither
tokenizer has a token across such a place, so each part is encoded and aligned once a
task, all new parts of a slice of texts in one pass over sorted arrays, and a text is
the concatenation of its parts.

A stored table has a row for each document, with its distinct pairs of linked ids and
how often it has each. The counts of pairs over all documents come from one aggregate;
they are joined back to the pairs. Up to ``BROADCAST`` distinct pairs are broadcast
after being counted; beyond, the join is a salted shuffle.

Edge cases: null and empty texts, and those whose tokens do not spell the blank and the
text (such as one with U+2581), have no tokens: zeros and the empty digest. Repeated
rows count once each. An empty table gives an empty result. Extra columns are not
carried. A part may be as long as its text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import ragged_arange
from subtide.llm.packing import encoder
from subtide.operators.relational import lookup_join
from subtide.sources import materialize

A, B = "byte_bpe_50k", "piece_bpe_32k.model"
BROADCAST = 1_000_000  # pairs of 17 bytes
SLICE = 1 << 21  # characters aligned at a time, or one text
REMEMBERED = 1 << 26  # bytes of the parts a task remembers
PART = 300  # bytes that each part takes beside its text, string and pairs
_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")

_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str):
    """Both encoders of lists of texts, and the bytes of both kinds of ids."""
    import public_tokenizers
    import sentencepiece

    with open(public_tokenizers.path(f"{a}.tiktoken"), "rb") as lines:
        of_a = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
    of_b = [
        bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))
    ]
    encode_a = encoder(a, plain_specials=True)
    return (
        lambda texts: encode_a([" " + t for t in texts]),
        lambda texts: pieces.encode(texts, num_threads=1),
        [of_a.get(i, b"") for i in range(max(of_a) + 1)],
        of_b,
    )


def coalesced(starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of intervals by start, and the group of each in that order."""
    order = np.lexsort((kinds, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    return order, np.cumsum(breaks) - 1


class Parts:
    """What a task knows of the parts it has met: numbers, group strings and linked pairs."""

    def __init__(self, a: str, b: str):
        self.encode_a, self.encode_b, self.bytes_a, self.bytes_b = tokenizers(a, b)
        self.width = len(self.bytes_b)
        self.size_a, self.size_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.strings: list[bytes] = []
        # By part: tokens of A, of B, groups, links, the first link, and whether the bytes agree.
        self.numbers = np.empty((0, 6), np.int64)
        self.pairs = np.empty(0, np.int64)
        self.held = 0

    def learn(self, texts: list[str]) -> None:
        if self.held > REMEMBERED:
            self.forget()
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        if not new:
            return
        ids = [self.encode_a(new), self.encode_b(new)]
        spelled = []
        for k, of in enumerate((self.bytes_a, self.bytes_b)):
            spelled.append([b"".join([of[i] for i in found]) for found in ids[k]])
        good = [x == y == b" " + t.encode() for t, x, y in zip(new, *spelled)]
        sizes = np.array([len(x) if g else 0 for x, g in zip(spelled[0], good)], np.int64)
        firsts = np.cumsum(sizes) - sizes
        flat, owner, ends = [], [], []
        for k, width in enumerate((self.size_a, self.size_b)):
            lengths = np.array([len(x) if g else 0 for x, g in zip(ids[k], good)], np.int64)
            flat.append(np.fromiter((i for x, g in zip(ids[k], good) if g for i in x), np.int64, lengths.sum()))
            owner.append(np.repeat(np.arange(len(new)), lengths))
            ends.append(np.cumsum(width[flat[k]]))
        starts = np.concatenate([e - w[i] for e, w, i in zip(ends, (self.size_a, self.size_b), flat)])
        kinds = np.repeat([0, 1], [len(x) for x in flat])
        order, group = coalesced(starts, np.concatenate(ends), kinds)
        of_part = np.concatenate(owner)[order]
        _, at_a, at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        links = np.bincount(owner[0][at_a], minlength=len(new))
        _, first_of_group = np.unique(group, return_index=True)
        numbers = np.stack(
            [
                np.bincount(owner[0], minlength=len(new)),
                np.bincount(owner[1], minlength=len(new)),
                np.bincount(of_part[first_of_group], minlength=len(new)),
                links,
                len(self.pairs) + np.cumsum(links) - links,
                np.array(good, np.int64),
            ],
            axis=1,
        )
        self.strings.extend(self._strings(np.concatenate(flat)[order], kinds[order], group, numbers[:, 2]))
        self.known.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        self.numbers = np.concatenate([self.numbers, numbers])
        self.pairs = np.concatenate([self.pairs, flat[0][at_a] * self.width + flat[1][at_b]])
        self.held += sum(map(len, new)) + sum(map(len, self.strings[-len(new) :])) + PART * len(new) + 8 * len(at_a)

    @staticmethod
    def _strings(ids: np.ndarray, kinds: np.ndarray, group: np.ndarray, groups: np.ndarray) -> Iterator[bytes]:
        """The string of the groups of each part."""
        by_kind = np.lexsort((np.arange(len(ids)), kinds, group))
        ids, kinds, group = ids[by_kind], kinds[by_kind], group[by_kind]
        # What follows an id: a comma, a bar after the last of A, a semicolon after the last of the group.
        after = np.full(len(ids), ",", object)
        after[:-1][kinds[1:] > kinds[:-1]] = "|"
        last = np.flatnonzero(np.diff(group, append=-1))
        after[last] = ";"
        written = [f"{i}{c}" for i, c in zip(ids.tolist(), after)]
        ends = [0, *(last + 1).tolist()]
        at = 0
        for n in groups.tolist():
            yield "".join(written[ends[at] : ends[at + n]])[:-1].encode()
            at += n


def _slices(texts: Iterator[str | None]) -> Iterator[list[str]]:
    """Texts (null as empty) in lists of about ``SLICE`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _aligned(parts: Parts, texts: list[str]) -> list[pa.Array]:
    """All columns but the id for a list of texts."""
    cut = [_CUT.split(t) if t else [] for t in texts]
    flat = [p for c in cut for p in c]
    parts.learn(flat)
    numbers = parts.numbers[np.fromiter(map(parts.known.__getitem__, flat), np.int64, len(flat))]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    agree = np.bincount(owner, minlength=len(texts)) == np.bincount(owner[numbers[:, 5] == 1], minlength=len(texts))
    numbers, owner = numbers[agree[owner]], owner[agree[owner]]
    sums = [np.bincount(owner, numbers[:, k], len(texts)).astype(np.int64) for k in range(4)]
    known, strings = parts.known, parts.strings
    digests = [
        hashlib.sha256(b";".join([strings[known[p]] for p in c])).hexdigest() if c and g else ""
        for c, g in zip(cut, agree.tolist())
    ]
    links = numbers[:, 3]
    pairs = parts.pairs[np.repeat(numbers[:, 4], links) + ragged_arange(links)]
    space = len(parts.bytes_a) * parts.width
    keys, times = np.unique(np.repeat(owner, links) * space + pairs, return_counts=True)
    offsets = np.searchsorted(keys, np.arange(len(texts) + 1) * space).astype(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (keys % space, times.astype(np.int32))]
    return [*map(pa.array, sums), pa.array(digests, pa.string()), *lists]


def align(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """One row a document: its numbers, the digest of its groups, its pairs (a * size of B + b) and their counts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(a, b)
        for batch in batches:
            at = 0
            for texts in _slices(t.as_py() for t in batch.column("text")):
                columns = _aligned(parts, texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *columns], names=names)
                at += len(texts)

    names = [c.split()[0] for c in _ROW.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, _ROW)


def pair_counts(aligned: DataFrame, b: str = B) -> DataFrame:
    """``pair``, its ``count`` over all documents and whether it is the ``best`` of its id of B."""
    width = len(tokenizers(A, b)[3])
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = materialize(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count")), "pair-counts")
    counts = counts.withColumn("b", F.pmod("pair", F.lit(width)))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_corpus(docs: DataFrame, a: str = A, b: str = B, broadcast: int = BROADCAST) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    stored = materialize(align(docs, a, b).withColumn("n", F.monotonically_increasing_id()), "alignment")
    counts = materialize(pair_counts(stored, b), "pairs")
    each = stored.select("n", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("n", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    if counts.count() <= broadcast:
        found = each.join(F.broadcast(counts), "pair")
    else:
        found = lookup_join(each, counts, ["pair"], "n")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    of_row = found.groupBy("n").agg(best, F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    whole = stored.drop("pairs", "times").join(of_row, "n", "left").na.fill(0, ["n_best", "count_sum"])
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
