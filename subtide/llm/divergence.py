"""How far the word use of sources differs, with terms counted by digest.

Groups of language and source are numbered first. Tasks count the terms of their texts
by group and term. What they hold is
written when it reaches ``ENTRIES`` terms, as rows of a 64-bit digest, the counts and,
in a column of its own, the string. The shuffle of counts reads the fixed-width columns
only. A second aggregate has the smallest and largest string of each digest, one row a
task and term; it is looked at for the digests that enough documents have. Where the
two strings differ, the digest stands for several terms: its rows are counted again by
string. Strings come back in the end for the terms that are put out. Up to ``BROADCAST``
kept terms, once counted, are broadcast to what they are looked up in; more are joined
by a shuffle.

Sources of a language are compared over all kept terms. The terms are dealt to slices
of about ``TERMS``, the sources to blocks of about ``BLOCK``; a task has the numbers of
two blocks in one slice as a matrix and puts out one sum for each pair of sources, so
no pair is put out term by term. Terms that none of these sources has are added as a
number times a difference.

Edge cases: null text, lang and source are empty; an empty text is a document without
terms. Each row is a document, repeated ones as well. A language without kept terms
has pairs of value 0. Ties are ordered by UTF-8 bytes. An empty table gives an empty
result. Extra columns are not carried.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from subtide.operators.relational import lookup_join
from subtide.sources import materialize

MIN_DOCUMENTS = 30
TOP = 50
SCALE = 10**9
PRIOR = 5
ENTRIES = 400_000
BROADCAST = 1_000_000  # kept terms, of some 40 bytes
TERMS = 512
BLOCK = 64
ROWS = 50_000  # written at a time
# A to Z in lower case; what is neither a letter nor beyond ASCII parts terms.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 32 for b in range(256))

_COUNTS = "lang_id long, group_id long, digest long, n long, docs long, term string, first boolean"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _digests(found: list[bytes], bits: int) -> np.ndarray:
    kept = (1 << bits) - 1
    return np.fromiter((xxh64_intdigest(t) & kept for t in found), np.uint64, len(found)).view(np.int64)


def count_terms(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Counts by task, group and term; ``first`` marks one row a term of those written together.

    ``docs`` has the columns lang_id, group_id and text.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(Counter)
        docs_of: dict = defaultdict(Counter)

        def write() -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for key, counts in n.items():
                found, numbers = list(counts), list(counts.values())
                for at in range(0, len(found), ROWS):
                    part = found[at : at + ROWS]
                    with_term = docs_of[key]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(np.full(len(part), k, np.int64)) for k in key),
                            pa.array(_digests(part, bits)),
                            pa.array(numbers[at : at + ROWS], pa.int64()),
                            pa.array([with_term[t] for t in part], pa.int64()),
                            pa.array(part, pa.binary()).cast(pa.string()),
                            pa.array([t not in seen for t in part]),
                        ],
                        names=["lang_id", "group_id", "digest", "n", "docs", "term", "first"],
                    )
                    seen.update(part)
            n.clear()
            docs_of.clear()

        entries = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            keys = zip(batch.column("lang_id").to_pylist(), batch.column("group_id").to_pylist())
            for text, key in zip(texts, keys):
                found = terms(text.as_py())
                counts = n[key]
                entries -= len(counts)
                counts.update(found)
                entries += len(counts)
                docs_of[key].update(set(found))
                if entries >= ENTRIES:
                    yield from write()
                    entries = 0
        yield from write()

    return docs.mapInArrow(of, _COUNTS)


def numbered_groups(docs: DataFrame) -> DataFrame:
    """``group_id``, ``lang``, ``source``, ``lang_id`` and ``n_sources`` of the groups that occur, stored."""
    given = materialize(docs.select("lang", "source").distinct().withColumn("group_id", F.monotonically_increasing_id()), "term-sources")
    of_lang = given.groupBy("lang").agg(F.min("group_id").alias("lang_id"), F.count("*").alias("n_sources"))
    return materialize(given.join(of_lang, "lang"), "term-sources")


def with_numbers(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang_id``, ``group_id`` and ``text`` of each row."""
    numbers = groups.select("lang", "source", "lang_id", "group_id")
    if groups.count() <= BROADCAST:
        found = docs.join(F.broadcast(numbers), ["lang", "source"])
    else:
        found = lookup_join(docs.withColumn("n", F.monotonically_increasing_id()), numbers, ["lang", "source"], "n")
    return found.select("lang_id", "group_id", "text")


def counted(docs: DataFrame, min_docs: int = MIN_DOCUMENTS, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (lang_id, group_id, digest, split, n, docs), kept terms and the strings of their digests.

    ``docs`` has the columns lang_id, group_id and text. ``split`` is the string where a
    digest stands for several terms, else empty. Kept terms have lang_id, digest, split,
    ``lang_n`` and a number ``term_id``; strings have digest and ``term``, one row a
    digest that is not split.
    """
    stored = materialize(count_terms(docs, bits), "terms")
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    by_digest = stored.groupBy("lang_id", "group_id", "digest").agg(*sums).withColumn("split", F.lit(""))
    counts = materialize(by_digest, "term-counts")

    def enough(given: DataFrame) -> DataFrame:
        found = given.groupBy("lang_id", "digest", "split").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        return found.filter(F.col("docs") >= min_docs).drop("docs")

    # A digest of several terms has as many documents as each of them at least.
    asked = materialize(enough(counts).select("digest").distinct(), "term-digests")
    few = asked.count() <= BROADCAST
    first = stored.filter("first").select("digest", "term")
    first = first.join(F.broadcast(asked), "digest", "left_semi") if few else first
    ends = first.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last"))
    strings = materialize(ends if few else ends.join(asked, "digest", "left_semi"), "term-strings")
    several = strings.filter("term <> last").select("digest")
    if not several.isEmpty():
        again = stored.join(several, "digest").groupBy("lang_id", "group_id", "digest", "term").agg(*sums)
        again = again.select("lang_id", "group_id", "digest", "n", "docs", F.col("term").alias("split"))
        counts = materialize(counts.join(several, "digest", "left_anti").unionByName(again), "term-counts")
    kept = materialize(enough(counts).withColumn("term_id", F.monotonically_increasing_id()), "terms-kept")
    return counts, kept, strings.filter("term = last").select("digest", "term")


def _share(count: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * v)), by whole numbers; 0 where v is 0."""
    exact = f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * ({count} + {PRIOR}) div ({total} + {PRIOR} * {v})"
    return F.expr(f"if({v} = 0, 0, {exact})").cast("long")


def _compared(part: pd.DataFrame) -> pd.DataFrame:
    """Sums over one slice of terms for the pairs of sources of two blocks."""
    known = part.drop_duplicates("group_id").sort_values("group_id")
    ids, p0 = known["group_id"].to_numpy(), known["p0"].to_numpy()
    own = (known["block"] == known["lo"]).to_numpy()
    real = part[part["term_id"].notna()]
    columns, names = pd.factorize(real["term_id"])
    matrix = np.repeat(p0[:, None], max(len(names), 1), axis=1)
    matrix[np.searchsorted(ids, real["group_id"].to_numpy()), columns] = real["p"].to_numpy()
    within = bool((known["lo"] == known["hi"]).all())
    out = []
    for i in range(len(ids)) if within else np.flatnonzero(own):
        others = np.arange(i + 1, len(ids)) if within else np.flatnonzero(~own)
        sums = np.abs(matrix[others] - matrix[i]).sum(axis=1) if len(names) else np.zeros(len(others), np.int64)
        # Over all terms, this difference is added for each; take it off for those of the slice.
        out.append(pd.DataFrame({"a": ids[i], "b": ids[others], "value": sums - len(names) * np.abs(p0[others] - p0[i])}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []}, dtype="int64")


def pairs(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``value`` for all ordered pairs of groups of one language.

    ``groups`` has group_id, lang_id, v, p0, block, blocks and slices; ``rows`` the terms
    that a group has: the same columns, term_id and p.
    """
    base = ["lang_id", "group_id", "block", "blocks", "p0"]
    none = F.lit(None).cast("long")
    everywhere = groups.select(*base, F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), none.alias("term_id"), none.alias("p"))
    of_terms = rows.select(*base, F.pmod(F.xxhash64("term_id"), "slices").alias("slice"), "term_id", "p")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    both = everywhere.unionByName(of_terms).withColumn("other", other)
    both = both.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    given = both.select("lang_id", "lo", "hi", "slice", "group_id", "block", "p0", "term_id", "p")
    parts = given.groupBy("lang_id", "lo", "hi", "slice").applyInPandas(_compared, "a long, b long, value long")
    sums = parts.groupBy("a", "b").agg(F.sum("value").alias("value"))
    of = groups.select("group_id", "v", "p0")
    left = of.select(F.col("group_id").alias("a"), "v", F.col("p0").alias("pa"))
    right = of.select(F.col("group_id").alias("b"), F.col("p0").alias("pb"))
    whole = lookup_join(lookup_join(sums, left, ["a"], "b"), right, ["b"], "a")
    whole = whole.withColumn("value", F.expr("value + v * abs(pa - pb)"))
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "value")
    return whole.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def top_terms(rows: DataFrame, strings: DataFrame, top: int = TOP) -> DataFrame:
    """``group_id``, ``item``, ``value`` and ``rank`` of the terms that a group has more of than its language.

    Slices by digest give their leading values, those the lowest value of the group's
    first ``top``. What reaches it is named, and ranked by name within the slices and
    then as a whole, so no task has all terms of a group, however many are tied.
    """
    slices = math.ceil(math.sqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    more = rows.filter("p > q").select("group_id", "digest", "split", F.expr("p - q").alias("value"))
    sliced = more.withColumn("slice", F.pmod(F.xxhash64("digest", "split"), F.lit(slices)))
    of_slice, of_group = (Window.partitionBy(*keys).orderBy(F.desc("value")) for keys in (["group_id", "slice"], ["group_id"]))
    leading = materialize(sliced.withColumn("at", F.rank().over(of_slice)).filter(F.col("at") <= top).drop("at"), "terms-leading")
    first = leading.select("group_id", "value", F.row_number().over(of_group).alias("at")).filter(F.col("at") <= top)
    least = first.groupBy("group_id").agg(F.min("value").alias("least"))
    reach = lookup_join(leading, least, ["group_id"], "digest").filter("value >= least")
    named = reach.join(strings, "digest", "left").withColumn("item", F.expr("if(split = '', term, split)"))
    by_name, whole = (Window.partitionBy(*keys).orderBy(F.desc("value"), "item") for keys in (["group_id", "slice"], ["group_id"]))
    few = named.withColumn("at", F.row_number().over(by_name)).filter(F.col("at") <= top)
    return few.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top).select("group_id", "item", "value", "rank")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCUMENTS, top: int = TOP, bits: int = 64) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: other sources and leading terms."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    given = docs.select(empty("lang"), empty("source"), empty("text"))
    numbered = numbered_groups(given)
    counts, kept, strings = counted(with_numbers(given, numbered), min_docs, bits)
    kept_or_broadcast = F.broadcast(kept) if kept.count() <= BROADCAST else kept
    shared = materialize(counts.drop("docs").join(kept_or_broadcast, ["lang_id", "digest", "split"]), "terms-shared")
    of_lang = kept.groupBy("lang_id").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = shared.groupBy("group_id").agg(F.sum("n").alias("total"))
    groups = numbered.join(totals, "group_id", "left").join(of_lang, "lang_id", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = groups.withColumns(
        {
            "p0": _share("0", "total", "v"),
            "slices": F.expr(f"CAST(greatest(1, ceil(v / {TERMS})) AS BIGINT)"),
            "blocks": F.expr(f"CAST(ceil(n_sources / {BLOCK}) AS BIGINT)"),
        }
    )
    groups = materialize(groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")), "term-groups")
    rows = lookup_join(shared.drop("lang_id"), groups, ["group_id"], "digest")
    rows = rows.withColumns({"p": _share("n", "total", "v"), "q": _share("lang_n", "lang_total", "v")})
    found = pairs(groups, rows)
    name = groups.select("group_id", "lang", "source")
    other = name.select(F.col("group_id").alias("b"), F.col("source").alias("item"))
    paired = lookup_join(lookup_join(found, name.withColumnRenamed("group_id", "a"), ["a"], "b"), other, ["b"], "a")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    paired = paired.withColumn("rank", F.row_number().over(order))
    leading = top_terms(rows, strings, top).join(name, "group_id")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(paired, "pair").unionByName(columns(leading, "term"))
