"""Repeated passages across documents by merging Burrows-Wheeler transforms.

A byte goes if a 50-byte string that covers it also starts in a document of a smaller
id. Three passes over the texts, in Spark tasks, with what they share kept as sorted
arrays below ``spark.checkpoint.dir`` (a folder mounted on all machines):

1. *Anchors.* Each 50-byte window names the 32 bytes in it whose hash is smallest.
   Equal windows name equal anchors, so a window whose anchor is in one document only
   has no equal elsewhere. Documents send each anchor's hash once; those that two
   documents sent are kept. This loses nothing and leaves out the unique text.
   The pass also counts, from above, the different stretches of text that name an
   anchor. An anchor of more than ``HOT`` is hot: its stretches are taken apart into
   windows, which go to parts by a hash of all their 50 bytes. Equal windows stay
   together, and what is left of a hot anchor's group is one string and its smallest
   document. So no group that is merged has more than ``GROUP + HOT`` strings.
2. *Merging.* The text around each kept anchor (all windows that name it, at most 68
   bytes) goes to the anchor's part, with the smallest document that has it; equal
   stretches are one string. A part deals the strings of some thousand anchors at a
   time to shards, builds each shard's transform, and merges the transforms: starting
   with the shards one after the other, it refines the interleave by one symbol (two
   bytes) a round. The rows of a block then share that many symbols, so after 25
   rounds the blocks are the intervals of suffixes with a common prefix of 50 bytes. No suffix of different
   shards is ever compared or sorted anew. The smallest document of an interval is
   that of each of its windows.
3. *Removal.* Each document looks up its stretches and drops what they tell it to.

Hashes of stretches have 128 bits. Rows of one id are not repeats of each other, as
neither is smaller; a null id is larger than all others. A null or empty text has no
bytes. A text below 50 bytes loses nothing. Repeated rows lose the same. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from subtide.llm.common import ragged_arange
from subtide.sources import shared_folder

LENGTH = 50
GRAM = 32
STRIDE = 2
SHARD = 2048  # strings
GROUP = 8192  # strings
HOT = 8192  # different stretches of one anchor
FILL = 400_000  # strings of a part, by the first pass's count
SLICE = 1 << 20  # bytes of text looked at at a time
CHUNK, PIECE = 1 << 17, 1 << 20  # bytes
HELD = 200_000  # strings, or eight times as many anchors, that a task adds up before it sends them
PARTS = 2  # for each shuffle partition, at least
# No byte of UTF-8 is above 244, so two of them and the end fit 16 bits.
BASE = 246
_LAST = int(np.iinfo(np.int64).max)
_NONE = (0, _LAST + 1)
_POSITION = np.uint64((1 << 24) - 1)
_LOW = np.uint64(24)


# ---- anchors


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    n = len(x) - GRAM + 8
    h = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        h += x[at : at + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each run of windows that name one anchor: text, anchor hash, first window, number of windows, key.

    The key has the anchor's hash above and a hash of the whole stretch in the low bits.

    Texts are joined to chunks, so that short ones don't cost a pass each; very long
    ones are cut into pieces that overlap by all but one byte of a window.
    """
    found, pieces, size = [], [], 0
    for doc, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, PIECE):
            pieces.append((doc, at, text[at : at + PIECE + LENGTH - 1] if len(text) > PIECE else text))
            size += len(pieces[-1][2])
            if size >= CHUNK:
                found.append(_chunk(pieces))
                pieces, size = [], 0
    if pieces:
        found.append(_chunk(pieces))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none, none.astype(np.uint64), none, none, none.astype(np.uint64))


def _chunk(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(x) for _, _, x in pieces])
    h = _gram_hashes(np.frombuffer(b"".join(x for _, _, x in pieces), np.uint8))
    # The place in the low bits makes the first of equal hashes the smallest.
    least = h & ~_POSITION | np.arange(len(h), dtype=np.uint64)
    width, done = LENGTH - GRAM + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    windows = lengths - LENGTH + 1
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts, windows) + ragged_arange(windows)
    piece = np.repeat(np.arange(len(pieces)), windows)
    anchor = (least[at] & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
    of = piece[first]
    doc, offset = (np.array([x[k] for x in pieces])[of] for k in (0, 1))
    count = np.diff(np.append(first, len(anchor)))
    # The first gram, the anchor and the last gram are all of a stretch.
    hashes, begin = h[anchor[first]], at[first]
    ends = h[begin] * np.uint64(0x9E3779B97F4A7C15) + h[begin + count - 1 + LENGTH - GRAM]
    ends = (ends ^ ends >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return doc, hashes, begin - starts[of] + offset, count, hashes & ~_POSITION | ends >> np.uint64(40)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_part(parts: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(parts, kind="stable")
    ends = np.searchsorted(parts[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(ends)):
        yield int(p), order[ends[p] : ends[p + 1]]


def _save(folder: str, name: str, values: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(own, values)
    os.replace(own, f"{folder}/{name}.npy")


@lru_cache(maxsize=8192)
def _load(folder: str, name: str) -> np.ndarray | None:
    path = f"{folder}/{name}.npy"
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of a part and packed columns."""
    part, *packed = zip(*rows)
    columns = [pa.array(part, pa.int32()), *[pa.array(c, pa.binary()) for c in packed]]
    return pa.RecordBatch.from_arrays(columns, names=["part", *names])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``SLICE`` bytes of text, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield batch.slice(at, end - at)
            at = end


def _squeezed(data: bytes) -> bytes:
    """Compressed bytes, for what is sent; texts of one part have much in common."""
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in batch.column("text")]


def _find_anchors(docs: DataFrame, folder: str, parts: int, hot: int) -> int:
    """Writes, by part, the sorted hashes of anchors that two documents have, and of the hot ones.

    The strings to come, counted from above, come back. A task's different stretches
    are counted exactly, those of two tasks as if all were different.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            each = np.sort(np.concatenate(keys))
            anchors, stretches = np.unique(each[np.diff(each, prepend=each[0] + np.uint64(1)) != 0] >> _LOW, return_counts=True)
            several = np.flatnonzero(stretches > 1)
            extra = np.zeros(len(hashes), "<u4")
            extra[np.searchsorted(hashes, anchors[several] << _LOW)] = stretches[several] - 1
            low = hashes.astype("<u4")
            rows = []
            for p, mine in _by_part(_part(hashes, parts), parts):
                both, more = mine[counts[mine] > 1], mine[extra[mine] > 0]
                rows.append((p, *(c.tobytes() for c in (low[mine], low[both], low[more], extra[more]))))
            yield _packed(rows, ["seen", "again", "more", "extra"])

        for batch in _sliced(batches):
            doc, hashes, _, _, key = _stretches(_texts(batch))
            keys.append(key)
            # Each document counts a hash once.
            order = np.lexsort((hashes, doc))
            doc, hashes = doc[order], hashes[order]
            once = np.ones(len(doc), bool)
            once[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
            held.append(hashes[once])
            n += len(held[-1])
            if n >= 8 * HELD:
                yield from flush()
                held, keys, n = [], [], 0
        if n:
            yield from flush()

    def keep(key: tuple, table: pa.Table) -> pa.Table:
        # The low half of the hash: parts split by the high half, and a false match only costs work.
        whole = lambda *names: np.concatenate([np.frombuffer(b.as_py(), "<u4") for c in names for b in table.column(c)])
        values, counts = np.unique(whole("seen", "again"), return_counts=True)
        strings = counts.copy()
        np.add.at(strings, np.searchsorted(values, whole("more")), whole("extra").astype(np.int64))
        kept, many = counts > 1, (counts > 1) & (strings > hot)
        p = key[0].as_py()
        _save(folder, f"anchors-{p}", values[kept])
        if many.any():
            _save(folder, f"hot-{p}", values[many])
        return pa.table({"n": [int(strings[kept].sum()) + (LENGTH - GRAM) * int(strings[many].sum())]})

    sent = docs.select("text").mapInArrow(send, "part int, seen binary, again binary, more binary, extra binary")
    return sent.groupBy("part").applyInArrow(keep, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _listed(folder: str, name: str, parts: int, hashes: np.ndarray) -> np.ndarray:
    """Which anchors are in the list of that name."""
    found = np.zeros(len(hashes), bool)
    for p, mine in _by_part(_part(hashes, parts), parts):
        known = _load(folder, f"{name}-{p}")
        if known is not None and len(known):
            low = hashes[mine].astype("<u4")
            found[mine] = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low
    return found


def _repeated(batch: pa.RecordBatch, folder: str, parts: int) -> tuple[list[bytes], np.ndarray, ...]:
    """The texts, and of their stretches with a kept anchor: document, hash, first window, number of windows.

    The stretches of a hot anchor are single windows, with a hash of their own.
    """
    texts = _texts(batch)
    doc, hashes, first, count, _ = _stretches(texts)
    kept = np.flatnonzero(_listed(folder, "anchors", parts, hashes))
    doc, hashes, first, count = doc[kept], hashes[kept], first[kept], count[kept]
    hot = _listed(folder, "hot", parts, hashes)
    if not hot.any():
        return texts, doc, hashes, first, count
    mine, windows = np.flatnonzero(hot), count[hot]
    apart, at = np.repeat(doc[mine], windows), np.repeat(first[mine], windows) + ragged_arange(windows)
    own = [xxh3_64_intdigest(texts[d][a : a + LENGTH]) for d, a in zip(apart.tolist(), at.tolist())]
    each = ((doc, apart), (hashes, np.array(own, np.uint64)), (first, at), (count, np.ones(len(at), np.int64)))
    return texts, *(np.concatenate([whole[~hot], single]) for whole, single in each)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(_LAST).to_numpy()


# ---- transforms


def transform(strings: list[bytes]) -> np.ndarray:
    """The transform of a shard in symbols of two bytes: what stands before each suffix, in suffix order.

    A string of n bytes has suffixes at 0 to n + 1, the last two empty; they come
    first, in order of strings, and 0 stands before the first two of each string.
    """
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(lengths + 4) - (lengths + 4)
    padded = np.zeros(int((lengths + 4).sum()) + 8, np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    at = np.repeat(starts, lengths) + ragged_arange(lengths)
    padded[at] = text.astype(np.int64) + 1
    symbols = padded[:-1] * BASE + padded[1:]
    symbols[padded[:-1] == 0] = 0
    rows = np.repeat(starts, lengths + 2) + ragged_arange(lengths + 2)
    place = np.full(len(padded) + 256, len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    # Rank by 3, 6, 12, ... symbols; empty suffixes are told apart by their number.
    empty = np.flatnonzero(symbols[rows] == 0)
    key = symbols[rows] << 32 | symbols[rows + STRIDE] << 16 | symbols[rows + 2 * STRIDE]
    key[empty] = np.arange(len(empty))
    reach = 3 * STRIDE
    rank = np.unique(key, return_inverse=True)[1]
    longest = int(lengths.max()) + 2 if len(lengths) else 0
    while reach < longest:
        after = place[np.minimum(rows + reach, len(place) - 1)]
        same = np.repeat(starts + lengths + 2, lengths + 2) > rows + reach
        following = np.where(same, rank[np.minimum(after, len(rows) - 1)] + 1, 0)
        rank = np.unique(rank * (len(rows) + 2) + following, return_inverse=True)[1]
        reach *= 2
    # Equal suffixes of several strings stand in order of the strings.
    order = np.argsort(rank, kind="stable")
    before = np.where(rows[order] >= np.repeat(starts, lengths + 2)[order] + STRIDE, symbols[np.maximum(rows[order] - STRIDE, 0)], 0)
    return before.astype(np.uint16)


def merge(transforms: list[np.ndarray], strings: list[int], rounds: int = LENGTH // STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Merges shard transforms; for each row of the shards, one after the other: its interval and its step back.

    ``strings`` has the number of strings of each shard. Rows of an interval share
    a prefix of ``rounds`` symbols. The step back leads to the row of the suffix
    that begins one symbol earlier.
    """
    sizes = [len(t) for t in transforms]
    offsets = np.cumsum([0, *sizes[:-1]])
    symbols = np.concatenate(transforms)
    back = np.full(len(symbols), -1, np.int32)
    for t, offset, n in zip(transforms, offsets, strings):
        order = np.argsort(t, kind="stable")
        back[order[2 * n :] + offset] = np.arange(2 * n, len(t)) + offset
    empty = np.concatenate([np.arange(2 * n) + offset for offset, n in zip(offsets, strings)]).astype(np.int32)
    # The interleave by no symbol at all: shard after shard, in one block.
    merged = np.arange(len(symbols), dtype=np.int32)
    block = np.zeros(len(symbols), np.int32)
    for _ in range(rounds):
        before = symbols[merged]
        order = np.argsort(before, kind="stable")[len(empty) :]
        rows, blocks = merged[order], block[order]
        # A block begins where the symbol before or the block behind changes.
        symbol = before[order]
        begins = (symbol[1:] != symbol[:-1]) | (blocks[1:] != blocks[:-1])
        merged[len(empty) :] = back[rows]
        merged[: len(empty)] = empty
        np.cumsum(begins, out=block[len(empty) + 1 :])
        block[len(empty) + 1 :] += len(empty)
        block[: len(empty) + 1] = np.arange(len(empty) + 1)[: len(block)]
    interval = np.empty(len(symbols), np.int32)
    interval[merged] = block
    return interval, back


def least_documents(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the strings: string, place and the smallest document whose string has it."""
    shards = [strings[i : i + SHARD] for i in range(0, len(strings), SHARD)]
    interval, back = merge([transform(s) for s in shards], [len(s) for s in shards])
    rows, lengths, offset = [], [], 0
    for shard in shards:
        n = np.fromiter(map(len, shard), np.int64, len(shard))
        rows.append(offset + 2 * np.arange(len(shard)))
        lengths.append(n)
        offset += int((n + 2).sum())
    first, length = np.concatenate(rows), np.concatenate(lengths)
    # From the ends of the strings backwards, all strings at once.
    found = []
    for parity in range(STRIDE):
        row, place, string = first + parity, length + parity, np.arange(len(strings))
        while len(row):
            is_window = (place >= 0) & (place <= length[string] - LENGTH)
            found.append((string[is_window], place[is_window], interval[row[is_window]]))
            row, place = back[row], place - STRIDE
            going = row >= 0
            row, place, string = row[going], place[going], string[going]
    string, place, of = (np.concatenate(c) for c in zip(*found))
    least = np.full(int(of.max(initial=0)) + 1, _LAST, np.int64)
    np.minimum.at(least, of, docs[string])
    return string, place, least[of]


def _groups(strings: np.ndarray, anchors: np.ndarray) -> Iterator[np.ndarray]:
    """The strings, whole anchors together, in groups of about ``GROUP`` that are merged by themselves."""
    order = strings[np.argsort(anchors[strings], kind="stable")]
    ends = np.flatnonzero(np.diff(anchors[order], append=-1)) + 1
    at = 0
    while at < len(order):
        end = ends[min(np.searchsorted(ends, at + GROUP), len(ends) - 1)]
        yield order[at:end]
        at = end


# ---- the operator


def _merge_parts(docs: DataFrame, folder: str, lists: int, parts: int) -> None:
    """Writes, by part, each stretch's hash and its runs of windows with their smallest document.

    ``lists`` is the number of parts that the anchors are listed by.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, tuple[int, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            strings = list(least)
            hashes = np.fromiter((v[0] for v in least.values()), np.uint64, len(least))
            own = np.fromiter((v[1] for v in least.values()), np.int64, len(least))
            lengths = np.fromiter(map(len, strings), np.uint8, len(strings))
            rows = []
            for p, mine in _by_part(_part(hashes, parts), parts):
                text = b"".join([strings[i] for i in mine.tolist()])
                rows.append((p, _squeezed(text), *(_squeezed(c[mine].tobytes()) for c in (lengths, hashes, own))))
            yield _packed(rows, ["text", "lengths", "anchors", "docs"])

        for batch in _sliced(batches):
            texts, doc, hashes, first, count = _repeated(batch, folder, lists)
            ids = _ids(batch).tolist()
            for d, h, a, n in zip(doc.tolist(), hashes.tolist(), first.tolist(), count.tolist()):
                string, own = texts[d][a : a + n + LENGTH - 1], ids[d]
                if own < least.get(string, _NONE)[1]:
                    least[string] = (h, own)
            if len(least) >= HELD:
                yield from flush()
                least = {}
        if least:
            yield from flush()

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        least: dict[bytes, tuple[int, int]] = {}
        for text, lengths, anchors, own in zip(*(table.column(c) for c in ("text", "lengths", "anchors", "docs"))):
            text, at = _unsqueezed(text.as_py()), 0
            sent = (np.frombuffer(_unsqueezed(x.as_py()), k).tolist() for x, k in ((lengths, np.uint8), (anchors, np.uint64), (own, np.int64)))
            for n, h, d in zip(*sent):
                string = text[at : at + n]
                at += n
                if d < least.get(string, _NONE)[1]:
                    least[string] = (h, d)
        strings = list(least)
        anchors = np.array([v[0] for v in least.values()], np.uint64)
        own = np.array([v[1] for v in least.values()], np.int64)
        least = None
        # An anchor with one string has nothing to merge: its windows have the string's document.
        _, of, times = np.unique(anchors, return_inverse=True, return_counts=True)
        several = times[of] > 1
        alone, shared = np.flatnonzero(~several), np.flatnonzero(several)
        string, place, doc = alone, np.zeros(len(alone), np.int64), own[alone]
        runs = [(string, place, doc)]
        for mine in _groups(shared, of):
            s, w, d = least_documents([strings[i] for i in mine.tolist()], own[mine])
            order = np.lexsort((w, s))
            s, w, d = s[order], w[order], d[order]
            begins = np.ones(len(s), bool)
            begins[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            runs.append((mine[s[begins]], w[begins], d[begins]))
        string, place, doc = (np.concatenate(c) for c in zip(*runs))
        digests = np.frombuffer(b"".join(xxh3_128_digest(x) for x in strings), np.uint64).reshape(-1, 2)
        order = np.argsort(digests[:, 0], kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        runs = np.lexsort((place, number[string]))
        p = key[0].as_py()
        _save(folder, f"stretches-{p}", digests[order])
        _save(folder, f"runs-{p}", np.searchsorted(number[string][runs], np.arange(len(strings) + 1)))
        _save(folder, f"places-{p}", place[runs].astype(np.uint8))
        _save(folder, f"docs-{p}", doc[runs])
        return pa.table({"n": [len(strings)]})

    sent = docs.select("doc_id", "text").mapInArrow(send, "part int, text binary, lengths binary, anchors binary, docs binary")
    sent.groupBy("part").applyInArrow(settle, "n long").agg(F.sum("n")).collect()


def _removed_windows(folder: str, parts: int, strings: list[bytes], hashes: np.ndarray, count: np.ndarray, ids: np.ndarray):
    """Runs of windows to remove: stretch, first window and end."""
    digests = np.frombuffer(b"".join(map(xxh3_128_digest, strings)), np.uint64).reshape(-1, 2)
    out = []
    for p, mine in _by_part(_part(hashes, parts), parts):
        known = _load(folder, f"stretches-{p}")
        at = np.searchsorted(known[:, 0], digests[mine, 0])
        # Equal first halves are as good as impossible, but cost little to tell apart.
        while (wrong := np.flatnonzero(known[at, 1] != digests[mine, 1])).size:
            at[wrong] += 1
        bounds, places, docs = (_load(folder, f"{name}-{p}") for name in ("runs", "places", "docs"))
        n = bounds[at + 1] - bounds[at]
        run = np.repeat(bounds[at], n) + ragged_arange(n)
        stretch = np.repeat(mine, n)
        begin = places[run].astype(np.int64)
        last = np.cumsum(n) - 1
        end = np.append(begin[1:], 0)
        end[last] = count[mine]
        gone = docs[run] < ids[stretch]
        out.append((stretch[gone], begin[gone], end[gone]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _folder(spark: SparkSession) -> str:
    base = urlparse(shared_folder(spark))
    if base.scheme not in ("", "file"):
        raise ValueError("memory-mapped arrays need a spark.checkpoint.dir that is mounted as a folder")
    return f"{base.path}/subtide/suffix-dedup-{uuid.uuid4().hex}"


def remove_repeats(docs: DataFrame, hot: int = HOT, fill: int = FILL) -> DataFrame:
    """``doc_id``, ``n_bytes``, the maximal removed runs (``starts``, ``ends``) and the bytes ``kept``."""
    spark = docs.sparkSession
    lists = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = _folder(spark)
    parts = max(lists, math.ceil(_find_anchors(docs, folder, lists, hot) / fill))
    _merge_parts(docs, folder, lists, parts)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts, doc, hashes, first, count = _repeated(batch, folder, lists)
            strings = [texts[d][a : a + n + LENGTH - 1] for d, a, n in zip(doc.tolist(), first.tolist(), count.tolist())]
            stretch, begin, end = _removed_windows(folder, parts, strings, hashes, count, _ids(batch)[doc])
            order = np.lexsort((first[stretch] + begin, doc[stretch]))
            of = doc[stretch][order]
            lo = (first[stretch] + begin)[order]
            hi = (first[stretch] + end)[order] + LENGTH - 1
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            out = []
            for d, text in enumerate(texts):
                a, b = lo[ends[d] : ends[d + 1]], hi[ends[d] : ends[d + 1]]
                if len(a):
                    # All runs have the same overhang, so ends are in order as well.
                    new = np.concatenate([[True], a[1:] > np.maximum.accumulate(b)[:-1]])
                    a, b = a[new], np.maximum.reduceat(b, np.flatnonzero(new))
                keep = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
                out.append((len(text), a, b, keep))
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "starts", "ends", "kept"])

    schema = "doc_id long, n_bytes long, starts array<bigint>, ends array<bigint>, kept binary"
    return docs.select("doc_id", "text").mapInArrow(drop, schema)
