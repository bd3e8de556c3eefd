"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Three passes over the texts. The first counts words; each task adds up its own and
sends them, by hash, to parts that keep sorted arrays of word hashes with counts.
A word's id is its place in those arrays. The second counts pairs of ids the same
way, each pair dealt to a part by a hash of both ids, so no word's pairs meet in one
task. Parts write sorted arrays of pair keys with counts, and send on, for each word,
how many distinct pairs it ends and how many it begins with count 1, 2 and more.
The third pass scores: workers map the files, which share the machine's page cache,
and find the distinct pairs of a batch by binary search.

Files lie below ``spark.checkpoint.dir``, which must be a folder mounted on all
machines. Parts are written under a name of their own and moved into place, so a
repeated task does no harm. There is one part for each shuffle partition; counts of
a word and sums do not depend on that number.

``p(w|v) = (c(vw) - D) / c(v) + g(v) p(w)`` with discounts D for counts 1, 2, 3 and
above, and the same over the number of distinct words before w for ``p(w)``, whose
rest is spread evenly over the vocabulary and one unknown word.

A word id has 32 bits; a vocabulary beyond that raises.

Edge cases: a null or empty text is the end token alone. The first word's context is
the end token. A null doc_id counts as an empty text for the choice of training
rows. Repeated rows count again. Without training rows all words are unknown and
equally likely. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from subtide.sources import materialize, shared_folder

# White space cannot be in a word.
END = xxh64_intdigest(b"\n")
FLUSH_TOKENS = 2_000_000
SLICE = 1000  # documents
MOST_WORDS = 1_000_000  # that a task numbers before it starts anew
LARGE = 255
FOLDS, HELD_OUT = 5, 1


def held_out(doc_id: str = "doc_id") -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key) % FOLDS == HELD_OUT


class Words(dict):
    """Numbers the words of a task; ``hashes`` has each one's hash."""

    def __init__(self):
        super().__init__()
        self.hashes = [END]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(xxh64_intdigest(word))
        return number

    def read(self, text: str | None) -> np.ndarray:
        """The text's words by number, then 0 for the end."""
        words = (text or "").encode().lower().split()
        return np.fromiter((*map(self.__getitem__, words), 0), np.int32, len(words) + 1)


def _combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Well-spread values of 64-bit keys."""
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)


def _parted(parts: np.ndarray, columns: list[np.ndarray], n_parts: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(parts, kind="stable")
    ends = np.searchsorted(parts[order], np.arange(n_parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(ends)):
        yield int(p), [c[ends[p] : ends[p + 1]] for c in columns]


def _rows(found: Iterator[tuple[int, list[np.ndarray]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for part, columns in found:
        values = [pa.array([part], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]]
        yield pa.RecordBatch.from_arrays(values, names=["part", *names])


def _save(folder: str, name: str, values: np.ndarray) -> None:
    own = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(own, values)
    os.replace(own, f"{folder}/{name}.npy")


@lru_cache(maxsize=4096)
def _load(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def _hash_part(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so ids follow the order of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b.as_py(), kind) for b in table.column(name)])


@dataclass(frozen=True)
class Model:
    """Where the files are, and the numbers that all of them share."""

    folder: str
    parts: int
    offsets: tuple[int, ...]  # the first id of each part
    tokens: int
    vocabulary: int
    pair_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    pairs: int = 0
    rest: float = 1.0  # what p(w) spreads evenly

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of word hashes, -1 for unknown ones."""
        found = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        parts = _hash_part(hashes[order], self.parts)
        ends = np.searchsorted(parts, np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(ends)):
            mine = order[ends[p] : ends[p + 1]]
            known = _load(self.folder, f"words-{p}")
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[mine]), len(known) - 1)
                found[mine] = np.where(known[at] == hashes[mine], at + self.offsets[p], -1)
        return found

    def by_word(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of a file of words; 0 for unknown ones."""
        found = np.zeros(len(ids))
        order = np.argsort(ids)
        ends = np.searchsorted(ids[order], np.append(self.offsets, self.vocabulary))
        for p in np.flatnonzero(np.diff(ends)):
            mine = order[ends[p] : ends[p + 1]]
            found[mine] = _load(self.folder, f"{name}-{p}")[ids[mine] - self.offsets[p]]
        return found

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct pair keys, 0 for unseen ones."""
        found = np.zeros(len(keys), np.int64)
        parts = (_mixed(keys) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(parts, kind="stable")
        ends = np.searchsorted(parts[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(ends)):
            mine = order[ends[p] : ends[p + 1]]
            known = _load(self.folder, f"pairs-{p}")
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
            same = known[at] == keys[mine]
            counts = _load(self.folder, f"counts-{p}")[at].astype(np.int64)
            large = same & (counts == LARGE)
            if large.any():
                where = np.searchsorted(_load(self.folder, f"large-{p}"), at[large])
                counts[large] = _load(self.folder, f"large_counts-{p}")[where]
            found[mine] = np.where(same, counts, 0)
        return found


def _train_text(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out()).select("text")


def _folder(spark: SparkSession) -> str:
    base = urlparse(shared_folder(spark))
    if base.scheme not in ("", "file"):
        raise ValueError("memory-mapped models need a spark.checkpoint.dir that is mounted as a folder")
    return f"{base.path}/subtide/kneser-ney-{uuid.uuid4().hex}"


def _words(docs: DataFrame, folder: str, parts: int) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = Words(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            counts = np.bincount(np.concatenate(held), minlength=len(words.hashes)).astype(np.uint32)
            keys = np.array(words.hashes, np.uint64)
            order = np.argsort(keys)
            yield from _rows(_parted(_hash_part(keys[order], parts), [keys[order], counts[order]], parts), ["keys", "counts"])

        for batch in batches:
            for text in batch.column("text"):
                held.append(words.read(text.as_py()))
                n += len(held[-1])
                if n >= FLUSH_TOKENS:
                    yield from flush()
                    words, held, n = Words(), [], 0
        if n:
            yield from flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _combined(_joined(table, "keys", np.uint64), _joined(table, "counts", np.uint32).astype(np.int64))
        keys, counts = keys[counts > 0], counts[counts > 0]
        os.makedirs(folder, exist_ok=True)
        _save(folder, f"words-{key[0].as_py()}", keys)
        _save(folder, f"tokens-{key[0].as_py()}", counts)
        return pa.table({"part": [key[0].as_py()], "words": [len(keys)], "tokens": [int(counts.sum())]})

    counted = _train_text(docs).mapInArrow(count, "part int, keys binary, counts binary")
    rows = {r.part: r for r in counted.groupBy("part").applyInArrow(merge, "part long, words long, tokens long").collect()}
    os.makedirs(folder, exist_ok=True)
    for p in range(parts):
        if p not in rows:
            _save(folder, f"words-{p}", np.zeros(0, np.uint64))
            _save(folder, f"tokens-{p}", np.zeros(0, np.int64))
    sizes = [rows[p].words if p in rows else 0 for p in range(parts)]
    if sum(sizes) >= 1 << 32:
        raise ValueError("the vocabulary has over 2^32 words")
    offsets = tuple(int(x) for x in np.cumsum([0, *sizes[:-1]]))
    return Model(folder, parts, offsets, sum(r.tokens for r in rows.values()), sum(sizes))


class Known:
    """Texts as word ids; a task looks each word up once."""

    def __init__(self, model: Model):
        self.model = model
        self.words, self.ids = Words(), model.ids(np.array([END], np.uint64))

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all tokens, text after text, and how many each text has."""
        if len(self.words) > MOST_WORDS:
            self.__init__(self.model)
        held = [self.words.read(t) for t in texts]
        new = np.array(self.words.hashes[len(self.ids) :], np.uint64)
        self.ids = np.concatenate([self.ids, self.model.ids(new)])
        return self.ids[np.concatenate(held)], np.array([len(t) for t in held])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _before(ids: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; a text's first one follows ``start``."""
    before = np.concatenate([[start], ids[:-1]])
    before[np.cumsum(lengths) - lengths] = start
    return before


def _discounts(n: np.ndarray) -> tuple[float, ...]:
    """Modified Kneser-Ney's three discounts from how many counts are 1, 2, 3 and 4."""
    if not n[0] or not n[1]:
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    found = [r + 1 - (r + 2) * y * n[r + 1] / n[r] if n[r] else (r + 1) / 2 for r in range(3)]
    return tuple(float(min(max(d, 0.0), r + 1)) for r, d in enumerate(found))


def _discount(counts: np.ndarray, discounts: tuple[float, ...]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]


def _spectrum(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def train(docs: DataFrame) -> Model:
    """Counts the documents that are not held out and writes the model's files."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = _words(docs, _folder(spark), parts)
    folder, offsets = model.folder, np.array(model.offsets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = _combined(np.concatenate(held), np.ones(n, np.uint32))
            parted = _parted((_mixed(keys) % np.uint64(parts)).astype(np.int64), [keys, counts], parts)
            split = ((p, [(k >> np.uint64(32)).astype("<u4"), k.astype("<u4"), c.astype("<u4")]) for p, (k, c) in parted)
            yield from _rows(split, ["first", "second", "counts"])

        known = Known(model)
        for batch in _sliced(batches):
            ids, lengths = known.read(batch.column("text").to_pylist())
            before = _before(ids, lengths, known.ids[0]).astype(np.uint64)
            held.append(before << np.uint64(32) | ids.astype(np.uint64))
            n += len(ids)
            if n >= FLUSH_TOKENS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        first, second, counts = (_joined(table, c, np.uint32) for c in ("first", "second", "counts"))
        keys, counts = _combined(first.astype(np.uint64) << np.uint64(32) | second, counts.astype(np.int64))
        _save(folder, f"pairs-{p}", keys)
        _save(folder, f"counts-{p}", np.minimum(counts, LARGE).astype(np.uint8))
        large = np.flatnonzero(counts >= LARGE)
        _save(folder, f"large-{p}", large)
        _save(folder, f"large_counts-{p}", counts[large])
        seconds, endings = np.unique(keys.astype("<u4"), return_counts=True)
        firsts = (keys >> np.uint64(32)).astype(np.int64)
        starts, at = np.unique(firsts, return_index=True)
        kinds = [np.add.reduceat((np.minimum(counts, 3) == k).astype(np.int64), at) for k in (1, 2, 3)]
        sent = {"end": (seconds.astype(np.int64), [endings]), "begin": (starts, kinds)}
        rows = []
        for kind, (ids, values) in sent.items():
            to = np.searchsorted(offsets, ids, "right") - 1
            to = np.where(ids < model.vocabulary, to, 0)
            for part, (own, *own_values) in _parted(to, [ids, *values], parts):
                rows.append((part, kind, (own - offsets[part]).astype("<u4").tobytes(), np.array(own_values, "<u4").tobytes(), None))
        rows.append((-1, "spectrum", b"", b"", _spectrum(counts).tolist()))
        return pa.Table.from_pylist([dict(zip(("part", "kind", "ids", "values", "spectrum"), r)) for r in rows], schema=sums_type)

    sums_type = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("values", pa.binary()), ("spectrum", pa.list_(pa.int64()))])
    counted = _train_text(docs).mapInArrow(count, "part int, first binary, second binary, counts binary")
    merged = materialize(counted.groupBy("part").applyInArrow(merge, "part int, kind string, ids binary, values binary, spectrum array<bigint>"), "kneser-ney-sums")
    spectra = merged.filter("part = -1").select(*[F.sum(F.get("spectrum", F.lit(i))).alias(f"n{i}") for i in range(4)]).first()
    pair_discounts = _discounts(np.array([x or 0 for x in spectra], float))

    def by_word(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        tokens = np.load(f"{folder}/tokens-{p}.npy")
        endings, begun = np.zeros(len(tokens), np.int64), np.zeros((3, len(tokens)), np.int64)
        for kind, ids, values in zip(*(table.column(c) for c in ("kind", "ids", "values"))):
            ids, values = np.frombuffer(ids.as_py(), "<u4"), np.frombuffer(values.as_py(), "<u4").reshape(-1, len(ids.as_py()) // 4)
            if kind.as_py() == "end":
                endings[ids] += values[0]
            else:
                begun[:, ids] += values
        _save(folder, f"endings-{p}", endings)
        _save(folder, f"backoff-{p}", (np.array(pair_discounts) @ begun / tokens).astype(np.float64))
        many = np.bincount(np.minimum(endings, 3), minlength=4)[1:]
        return pa.table({"spectrum": [_spectrum(endings).tolist()], "many": [many.tolist()], "pairs": [int(endings.sum())]})

    rows = merged.filter("part >= 0").groupBy("part").applyInArrow(by_word, "spectrum array<bigint>, many array<bigint>, pairs bigint").collect()
    pairs = sum(r.pairs for r in rows)
    word_discounts = _discounts(np.sum([r.spectrum for r in rows], 0, dtype=float)) if rows else (0.0,) * 3
    rest = float(np.dot(word_discounts, np.sum([r.many for r in rows], 0)) / pairs) if pairs else 1.0
    return Model(folder, parts, model.offsets, model.tokens, model.vocabulary, pair_discounts, word_discounts, pairs, rest)


def probabilities(model: Model, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """p(word | word before) for ids; -1 is unknown."""
    even = model.rest / (model.vocabulary + 1)
    if not model.pairs:
        return np.full(len(ids), even)
    words, back = np.unique(ids, return_inverse=True)
    endings = model.by_word("endings", words)
    lower = np.where(words >= 0, (endings - _discount(endings, model.word_discounts)) / model.pairs, 0.0)[back] + even
    contexts, back = np.unique(before, return_inverse=True)
    seen, backoff = (model.by_word(name, contexts)[back] for name in ("tokens", "backoff"))
    both = (before >= 0) & (ids >= 0)
    keys, back = np.unique(before[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64), return_inverse=True)
    counts = np.zeros(len(ids))
    counts[both] = model.pair_counts(keys)[back]
    higher = (counts - _discount(counts, model.pair_discounts)) / np.maximum(seen, 1)
    return np.where(before >= 0, higher + backoff * lower, lower)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each text: tokens, known ones, the unigram baseline and the model's log10 probability."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model)
        for batch in _sliced(batches):
            ids, lengths = known.read(batch.column("text").to_pylist())
            first = np.cumsum(lengths) - lengths
            before = _before(ids, lengths, known.ids[0])
            n = batch.num_rows
            words, back = np.unique(ids, return_inverse=True)
            seen = model.by_word("tokens", words)[back]
            base = np.log10((seen + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
            log = np.log10(probabilities(model, before, ids))
            columns = [
                pa.array(lengths, pa.int64()),
                pa.array(np.add.reduceat((ids >= 0).astype(np.int64), first)),
                pa.array(np.full(n, model.tokens, np.int64)),
                pa.array(np.add.reduceat(base, first)),
                pa.array(np.add.reduceat(log, first)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "held_out"]).columns, *columns], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(of, schema)
