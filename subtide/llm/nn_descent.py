"""Approximate nearest neighbours by inner product: a graph from NN-descent, greedy search in it.

Equal vectors are one node. First neighbours come from blocks of nodes that lie next
to each other in a few random orders. Then each round joins every node's neighbours,
forward and backward ones, with their vectors, compares them with one another, and
sends each the better ones: a node's neighbours' neighbours. Only pairs with a
neighbour that is new since the last round are compared. The lists of a round are
stored; a lost executor costs one round's tasks at most. Lists have ``k`` entries and
backward lists are a sample of as many, so no hub's list grows with the data.

For the search, vectors and lists are written as arrays by part below
``spark.checkpoint.dir``, which must be a folder mounted on all machines, and mapped
into memory by the workers. A search keeps the best ``beam`` nodes seen, opens the
best unopened ones and ends when all are open. It starts at a fixed sample of nodes
and at the query's own node, if that is in the graph. Scores are in double precision.

Edge cases: rows with a null id, and vectors that are null, zero, or hold null or
non-finite components, take no part; nor do vectors of another length than most have.
Repeated rows count once, in the index and among the queries. An id with several
vectors is one neighbour and one query: a pair of ids has the best score of their
vectors. Equal vectors are all found, smallest id first. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subtide.sources import materialize, shared_folder

K = 24
SAMPLE = 16
SENT = 4
ORDERS = 3
BLOCK = 256
ROUNDS = 5
BEAM = 640
OPENED = 24
ENTRIES = 64
SEED = 5
_BITS = 33  # of monotonically_increasing_id for the row in its partition


@dataclass(frozen=True)
class Index:
    """``nodes`` has ``pos``, ``vector`` and ``members`` (the smallest ids of equal rows).

    ``repeats`` says whether an id is a member of several nodes.
    """

    nodes: DataFrame | None
    folder: str
    offsets: tuple[int, ...]
    size: int
    entries: tuple[int, ...]
    repeats: bool

    def rows(self, name: str, at: np.ndarray) -> np.ndarray:
        """Rows of a stored array by position."""
        part = np.searchsorted(self.offsets, at, "right") - 1
        found = None
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            got = _load(self.folder, f"{name}-{p}")[at[mine] - self.offsets[p]]
            if found is None:
                found = np.empty((len(at), *got.shape[1:]), got.dtype)
            found[mine] = got
        return found


@lru_cache(maxsize=4096)
def _load(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def _save(folder: str, name: str, values: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(own, values)
    os.replace(own, f"{folder}/{name}.npy")


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` (array of double) of the rows that take part."""
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("vector", lambda x: x != 0)
    good = given.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(nonzero, F.lit(False)))
    lengths = good.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.agg(F.max(F.struct("rows", "n"))["n"].alias("n")).first()["n"]
    return good.filter(F.size("vector") == (common or 0))


def _nodes(vectors: DataFrame, members: int) -> tuple[DataFrame, tuple[int, ...], int]:
    first = Window.partitionBy("vector").orderBy("vec_id")
    # The limit also cuts each task's rows before the shuffle, so copies do not pile up.
    few = vectors.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= members)
    grouped = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    spread = grouped.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("members")[0])
    stored = materialize(spread.withColumn("number", F.monotonically_increasing_id()), "nn-nodes")
    part, row = F.shiftright("number", _BITS).cast("int"), F.col("number").bitwiseAND((1 << _BITS) - 1)
    counts = {r["part"]: r["count"] for r in stored.groupBy(part.alias("part")).count().collect()}
    sizes = [counts.get(p, 0) for p in range(max(counts, default=0) + 1)]
    offsets = tuple(int(x) for x in np.cumsum([0, *sizes[:-1]]))
    base = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), part + 1)
    numbered = stored.select((base + row).alias("pos"), part.alias("part"), "vector", "members")
    return numbered, offsets, sum(sizes)


def _matrix(column, width: int | None = None) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1 if len(values) else (width or 1))


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of each row, best first."""
    k = min(k, scores.shape[1])
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, 1), axis=1, kind="stable"), 1)


def _first_lists(nodes: DataFrame, k: int, dim: int) -> DataFrame:
    """``pos`` and ``found`` (neighbours with scores) from blocks of a few random orders."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, vectors = batch.column("pos").to_numpy(), _matrix(batch.column("vector")).astype(np.float32)
            for at in range(0, len(pos), BLOCK):
                ids, v = pos[at : at + BLOCK], vectors[at : at + BLOCK]
                if len(ids) < 2:
                    continue
                scores = v @ v.T
                np.fill_diagonal(scores, -np.inf)
                best = _top(scores, min(k, len(ids) - 1))
                yield _lists(ids, ids[best], np.take_along_axis(scores, best, 1))

    rng = np.random.default_rng(SEED)
    made = None
    for _ in range(ORDERS):
        planes = rng.standard_normal((9, dim))
        side = [F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(x)) for x in p]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for p in planes]
        code = F.concat(*[F.when(s > 0, "1").otherwise("0") for s in side[1:]])
        ordered = nodes.select("pos", "vector", code.alias("code"), side[0].alias("side"))
        parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = ordered.repartitionByRange(parts, "code", "side").sortWithinPartitions("code", "side")
        found = ordered.select("pos", "vector").mapInArrow(compare, _LISTS)
        made = found if made is None else made.union(found)
    return made


_LISTS = "pos long, ids array<bigint>, scores array<float>"


def _lists(pos: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """A batch of equally long lists."""
    ends = pa.array(np.arange(len(pos) + 1) * ids.shape[1], pa.int32())
    columns = [pa.array(pos), pa.ListArray.from_arrays(ends, pa.array(ids.ravel())), pa.ListArray.from_arrays(ends, pa.array(scores.ravel().astype(np.float32)))]
    return pa.RecordBatch.from_arrays(columns, names=["pos", "ids", "scores"])


def _merged(found: DataFrame, old: DataFrame | None, k: int) -> DataFrame:
    """The best ``k`` of all that was found for each node, ``new`` where the old list lacks it."""
    known = F.lit(None).cast(_OLD)
    rows = found.select("pos", "ids", "scores", known.alias("old"))
    if old is not None:
        rows = rows.unionByName(old.select("pos", "ids", "scores", F.col("ids").alias("old")))
    grouped = rows.groupBy("pos").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"), F.first("old", ignorenulls=True).alias("old"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, ids, scores, before in zip(*(batch.column(c) for c in ("pos", "ids", "scores", "old"))):
                ids, scores = ids.values.to_numpy(), scores.values.to_numpy()
                _, first = np.unique(ids, return_index=True)
                first = first[np.lexsort((ids[first], -scores[first]))][:k]
                before = before.values.to_numpy() if before.is_valid else []
                out.append((pos.as_py(), ids[first], scores[first], ~np.isin(ids[first], before)))
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["pos", "ids", "scores", "new"])

    return grouped.mapInArrow(best, f"{_LISTS}, new array<boolean>")


_OLD = "array<bigint>"


def _round(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Better neighbours among the neighbours' neighbours, as lists."""
    worst = F.element_at("scores", -1).alias("worst")
    edges = graph.select("pos", F.posexplode(F.arrays_zip("ids", "new")).alias("at", "e")).select("pos", F.col("e.ids").alias("id"), F.col("e.new").alias("new"), "at")
    # New ones first, then near ones; for backward edges a sample by hash.
    fresh = F.when(F.col("new"), 0).otherwise(1)
    forward = edges.withColumn("n", F.row_number().over(Window.partitionBy("pos").orderBy(fresh, "at"))).filter(F.col("n") <= SAMPLE).select("pos", "id", "new")
    drawn = Window.partitionBy("id").orderBy(fresh, F.xxhash64("pos", "id"))
    backward = edges.withColumn("n", F.row_number().over(drawn)).filter(F.col("n") <= SAMPLE).select(F.col("id").alias("pos"), F.col("pos").alias("id"), "new")
    met = forward.union(backward).groupBy("pos", "id").agg(F.max("new").alias("new"))
    vectors = nodes.select("pos", F.col("vector").cast("array<float>").alias("vector")).join(graph.select("pos", worst), "pos").withColumnRenamed("pos", "id")
    held = met.join(vectors, "id").groupBy("pos").agg(F.collect_list(F.struct("id", "new", "worst", "vector")).alias("met"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column("met"), []
            ends = lists.offsets.to_numpy()
            fields = lists.values
            ids, new, worst = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("id", "new", "worst"))
            v = _matrix(fields.field("vector"))
            for a, b in zip(ends[:-1], ends[1:]):
                scores = v[a:b] @ v[a:b].T
                useful = (new[a:b, None] | new[None, a:b]) & (scores > worst[a:b, None])
                np.fill_diagonal(useful, False)
                scores = np.where(useful, scores, -np.inf)
                best = _top(scores, SENT)
                got = np.take_along_axis(scores, best, 1)
                for i in np.flatnonzero(got[:, 0] > -np.inf):
                    some = got[i] > -np.inf
                    out.append((ids[a + i], ids[a + best[i][some]], got[i][some]))
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32())]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["pos", "ids", "scores"])

    return held.select("met").mapInArrow(compare, _LISTS)


def build(vectors: DataFrame, members: int, k: int = K, rounds: int = ROUNDS) -> Index:
    """The graph over the rows of :func:`usable`."""
    spark = vectors.sparkSession
    base = urlparse(shared_folder(spark))
    if base.scheme not in ("", "file"):
        raise ValueError("memory-mapped graphs need a spark.checkpoint.dir that is mounted as a folder")
    folder = f"{base.path}/subtide/nn-descent-{uuid.uuid4().hex}"
    nodes, offsets, size = _nodes(vectors, members)
    dim = len(nodes.select("vector").first()["vector"]) if size else 1
    graph = materialize(_merged(_first_lists(nodes, k, dim), None, k), "nn-graph")
    for _ in range(rounds):
        graph = materialize(_merged(_round(graph, nodes), graph, k), "nn-graph")
        if graph.filter(F.exists("new", lambda x: x)).isEmpty():
            break
    edges = graph.select("pos", F.explode("ids").alias("id"), F.lit(0).alias("kind"))
    back = edges.select(F.col("id").alias("pos"), F.col("pos").alias("id"))
    drawn = Window.partitionBy("pos").orderBy(F.xxhash64("id", "pos"))
    back = back.withColumn("n", F.row_number().over(drawn)).filter(F.col("n") <= k).select("pos", "id")
    lists = edges.select("pos", "id").union(back).groupBy("pos").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    placed = nodes.select("part", "pos", "vector").join(lists, "pos", "left")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        table = table.sort_by("pos")
        ids = np.full((table.num_rows, 2 * k), -1, np.int64)
        for row, found in enumerate(table.column("ids")):
            found = found.values.to_numpy() if found.is_valid else np.zeros(0, np.int64)
            ids[row, : len(found)] = found
        _save(folder, f"vectors-{part}", _matrix(table.column("vector")))
        _save(folder, f"lists-{part}", ids)
        return pa.table({"rows": [table.num_rows]})

    placed.groupBy("part").applyInArrow(write, "rows long").agg(F.sum("rows")).collect()
    entries = [r["pos"] for r in nodes.select("pos").orderBy(F.xxhash64(F.col("members")[0]), "pos").limit(ENTRIES).collect()]
    uses = nodes.select(F.explode("members").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    repeats = not uses.filter("n > 1").isEmpty()
    return Index(nodes, folder, offsets, size, tuple(sorted(entries)), repeats)


def _leading(scores: np.ndarray, n: int, slack: float = 1e-9) -> np.ndarray:
    """Places of the ``n`` best scores and of all that are tied with the last, up to rounding."""
    if len(scores) <= n:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - n)[len(scores) - n]
    return np.flatnonzero(scores >= last - slack * max(1.0, abs(last)))


def greedy(index: Index, query: np.ndarray, start: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the best nodes met, best first; ties with the last of the beam are kept."""
    seen = np.unique(start)
    ids, scores, open_ = seen, index.rows("vectors", seen) @ query, np.ones(len(seen), bool)
    while open_.any():
        places = np.flatnonzero(open_)
        chosen = places[np.argsort(-scores[places], kind="stable")[:OPENED]]
        open_[chosen] = False
        near = np.unique(index.rows("lists", ids[chosen]))
        near = np.setdiff1d(near[near >= 0], seen, assume_unique=True)
        if not len(near):
            continue
        seen = np.union1d(seen, near)
        ids = np.concatenate([ids, near])
        scores = np.concatenate([scores, index.rows("vectors", near) @ query])
        open_ = np.concatenate([open_, np.ones(len(near), bool)])
        if len(ids) > beam:
            kept = _leading(scores, beam)
            ids, scores, open_ = ids[kept], scores[kept], open_[kept]
    order = np.lexsort((ids, -scores))
    return ids[order], scores[order]


def search(index: Index, queries: DataFrame, top: int, beam: int = BEAM) -> DataFrame:
    """The ``top`` nearest rows found for each query (``vec_id``, ``vector``), but for itself.

    ``query_id``, ``rank``, ``vec_id``, ``score``; ties go to the smaller id. Where ids
    have several vectors, all the nodes that a search keeps are ranked, so that nodes
    of one id do not take the places of others.
    """
    own = queries.select("vec_id", "vector").distinct().join(index.nodes.select("vector", F.col("pos").alias("own")), "vector", "left")
    files = replace(index, nodes=None)
    # A node more than the top, as the query itself may be one.
    places = beam if index.repeats else top + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query_id, own, query in zip(batch.column("vec_id"), batch.column("own"), _matrix(batch.column("vector"))):
                start = np.array([*files.entries, *([own.as_py()] if own.is_valid else [])], np.int64)
                pos, rough = greedy(files, query, start, beam)
                pos = pos[_leading(rough, places)]
                scores = (files.rows("vectors", pos) * query).sum(1)
                exact = _leading(scores, places, slack=0.0)
                pos, scores = pos[exact], scores[exact]
                out += [(query_id.as_py(), int(p), float(s)) for p, s in zip(pos, scores)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, [pa.int64(), pa.int64(), pa.float64()])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "pos", "score"])

    spread = own.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    found = spread.select("vec_id", "own", "vector").mapInArrow(find, "query_id long, pos long, score double")
    rows = found.join(index.nodes.select("pos", F.explode("members").alias("vec_id")), "pos").filter("vec_id <> query_id")
    rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
