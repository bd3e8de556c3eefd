"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose measure lies above a cutoff. The cutoff of a
rule is chosen for each stratum (language) from labelled holdout documents: the
strictest one for which an exact binomial bound shows that at most ``risk`` of the
good documents are rejected. The bound is Clopper-Pearson's: a cutoff that rejects
k of n good documents holds if P(X <= k) under Binomial(n, risk) is at most the
error level, which is ``error`` divided by the number of tests (Bonferroni over
rules, cutoffs and strata). ``risk`` is divided among the rules, so all of them
together stay within it. A stratum with too few labels gets no cutoff and loses
nothing.

Everything is column expressions and aggregates. Two windows of five words count as
equal if their 64-bit hashes are.

Edge cases: a null or empty text has no words (all counts 0, it fails the base
rules). A null language is a stratum of its own. A document with several labels is
good only if all of them say so; labels that are null, or of no document, are not
used. Repeated rows are judged row by row. Extra columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from subtide.llm.common import SPACE, let, text_or_empty
from subtide.sources import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
RISK = 0.02
ERROR = 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose ``measure`` is above the chosen cutoff."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / word_chars", (0.01, 0.02, 0.05, 0.1, 0.2, 0.3)),
    Rule("dup_lines", "n_dup_lines / n_lines", (0.05, 0.1, 0.2, 0.3, 0.5)),
    Rule("repeats", "n_repeat_words / n_words", (0.02, 0.05, 0.1, 0.15)),
    Rule("long_words", "word_chars / n_words", (8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
)


def _windows(words: Column) -> Column:
    """The hash of the words from each position to the fourth after it."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    last = F.size(words) - WINDOW

    def windows(h: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), last), at)

    none = F.array().cast("array<bigint>")
    return F.when(last >= 0, let(hashes, windows)).otherwise(none)


def _covered(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more."""

    def of(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(
                (x["h"] == F.get(s, j - 1)["h"]), F.lit(False)
            ) | F.coalesce((x["h"] == F.get(s, j + 1)["h"]), F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        def union(p: Column) -> Column:
            own = lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))
            return F.aggregate(F.transform(p, own), F.lit(0).cast("int"), lambda a, b: a + b)

        repeated = let(let(pairs, starts), union)
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(repeated)

    return let(windows, of)


def features(docs: DataFrame, carry: bool = True) -> DataFrame:
    """``doc_id``, the stratum and the counts of each document; ``row`` has the row itself if carried."""
    text = text_or_empty()
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _covered(_windows(w)).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    found = docs.select(
        (F.struct("*") if carry else F.lit(None)).alias("row"),
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("stratum"),
        counts.alias("of_words"),
        of_lines.alias("of_lines"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n, repeats = F.col("of_words.n_words"), F.col("of_words.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    return found.select(
        *(["row"] if carry else []),
        "doc_id",
        "stratum",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "of_lines.n_lines",
        "of_lines.n_dup_lines",
        repeats.alias("n_repeat_words"),
        failed.alias("base_failed"),
    )


def _measure(rule: Rule) -> Column:
    return F.expr(f"coalesce(try_divide({rule.measure.replace(' / ', ', ')}), 0.0D)")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of Binomial(n, p) for k below n * p, and 1 from there on.

    The largest term is taken from logarithms, the smaller ones relative to it.
    """
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_choose = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def smaller(a: Column, i: Column) -> Column:
        j = k - i + 1
        term = a["term"] * (j / (n - j + 1)) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.aggregate(steps, start, smaller)["total"]
    largest = F.exp(log_choose + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p)))
    return F.when(k < n * p, largest * total).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, rules=RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The chosen cutoff of each rule (null: none) for each labelled stratum, one row for each stratum.

    Of the cutoffs that hold, those count that reject a larger share of the bad
    documents than of the good ones.
    """
    marked = (
        labels.select("doc_id", "quality")
        .dropna()
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("good"))
    )
    known = measured.filter(~F.col("base_failed")).join(marked, "doc_id")
    sides = {"good": F.col("good"), "bad": ~F.col("good")}
    totals = [F.count_if(is_side).alias(f"n_{side}") for side, is_side in sides.items()]
    rejected = [
        F.count_if(is_side & (_measure(rule) > cutoff)).alias(f"{side}_{r}_{c}")
        for r, rule in enumerate(rules)
        for c, cutoff in enumerate(rule.cutoffs)
        for side, is_side in sides.items()
    ]
    counts = known.groupBy("stratum").agg(*totals, *rejected)
    tests = F.count(F.lit(1)).over(_everything()) * sum(len(rule.cutoffs) for rule in rules)
    counted = counts.withColumn("level", F.lit(error) / tests)
    chosen = []
    for r, rule in enumerate(rules):
        holding = []
        for c, cutoff in enumerate(rule.cutoffs):
            good, bad = F.col(f"good_{r}_{c}"), F.col(f"bad_{r}_{c}")
            bound = binomial_cdf(good, F.col("n_good"), risk / len(rules)) <= F.col("level")
            useful = bad * F.col("n_good") > good * F.col("n_bad")
            holding.append(F.when(bound & useful, F.lit(cutoff)))
        chosen.append(F.array_min(F.array(*holding)).alias(f"cutoff_{rule.name}"))
    return counted.select("stratum", *chosen)


def joint_cutoffs(measured: DataFrame, labels: DataFrame, rules=RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Like :func:`cutoffs`, with the risk bounded once for all rules together.

    Rules are added one after the other. Those already added and a cutoff of the next
    may together reject the whole ``risk``. A rule's cutoffs reject ever more, so they
    are tested from the loosest on and the first that fails ends it, which needs no
    correction. The error is divided among strata and rules, and a rule's share among
    all the outcomes that the rules before it can have. Of the cutoffs that hold, those
    count that reject a larger share of the bad documents than of the good ones among
    the documents that no earlier rule rejects.
    """
    marked = (
        labels.select("doc_id", "quality")
        .dropna()
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("good"))
    )
    known = measured.filter(~F.col("base_failed")).join(marked, "doc_id")
    # How many cutoffs of each rule a document exceeds says all: one row for each combination.
    above = [sum((_measure(rule) > c).cast("int") for c in rule.cutoffs).alias(f"above_{r}") for r, rule in enumerate(rules)]
    found = known.select("stratum", "good", *above).groupBy("stratum", "good", *[f"above_{r}" for r in range(len(rules))]).agg(F.count(F.lit(1)).alias("n"))
    strata = found.select("stratum").distinct().withColumn("strata", F.count(F.lit(1)).over(_everything()))
    found = found.join(strata, "stratum").withColumn("rejected", F.lit(False))
    whole = Window.partitionBy("stratum")
    counted = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))).over(whole), F.lit(0))
    found = found.withColumn("n_good", counted(F.col("good"))).withColumn("n_bad", counted(~F.col("good")))
    outcomes = 1
    for r, rule in enumerate(rules):
        level = F.lit(error / (len(rules) * outcomes)) / F.col("strata")
        ascending = sorted(rule.cutoffs)
        totals = []
        for c in range(len(ascending)):
            above = F.col(f"above_{r}") > c
            totals.append(F.struct(counted(F.col("good") & (F.col("rejected") | above)).alias("joint"), counted(F.col("good") & above & ~F.col("rejected")).alias("good"), counted(~F.col("good") & above & ~F.col("rejected")).alias("bad")).alias(f"of_{c}"))
        found = found.select("*", *totals)
        holding = []
        for c in range(len(ascending)):
            of = F.col(f"of_{c}")
            bound = binomial_cdf(of["joint"], F.col("n_good"), risk) <= level
            useful = of["bad"] * F.col("n_good") > of["good"] * F.col("n_bad")
            holding.append(F.when(bound & useful, F.lit(c)))
        # The bound only rises with the count, so none of the looser ones fails before it.
        found = found.withColumn("c", F.array_min(F.array(*holding))).drop(*[f"of_{c}" for c in range(len(ascending))])
        found = found.withColumn("rejected", F.col("rejected") | F.coalesce(F.col(f"above_{r}") > F.col("c"), F.lit(False)))
        found = found.withColumn(f"cutoff_{rule.name}", F.get(F.array(*map(F.lit, ascending)), F.col("c"))).drop("c")
        outcomes *= len(ascending) + 1
    return found.groupBy("stratum").agg(*[F.first(f"cutoff_{rule.name}").alias(f"cutoff_{rule.name}") for rule in rules])


def _everything() -> WindowSpec:
    """All strata together: one row for each language, already aggregated."""
    return Window.partitionBy(F.lit(0))


def judge(measured: DataFrame, chosen: DataFrame, rules=RULES) -> DataFrame:
    """``kept``: neither the base rules nor a chosen cutoff reject the document."""
    rejected = F.lit(False)
    for rule in rules:
        rejected = rejected | F.coalesce(_measure(rule) > F.col(f"cutoff_{rule.name}"), F.lit(False))
    joined = measured.join(chosen, "stratum", "left")
    return joined.withColumn("kept", ~(F.col("base_failed") | rejected))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    carry: bool = False,
    rules=RULES,
    risk: float = RISK,
    error: float = ERROR,
    choose=cutoffs,
) -> DataFrame:
    """The measures and the verdict of each document, with its ``row`` if carried.

    Measures are stored once; choosing cutoffs and judging read them back.
    """
    measured = materialize(features(docs, carry), "quality")
    # Stored as well, a row for each stratum, so that its true size decides the join.
    chosen = materialize(choose(measured, labels, rules, risk, error), "quality-cutoffs")
    return judge(measured, chosen, rules)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns; cutoffs are the joint ones."""
    return quality(docs, labels, carry=True, choose=joint_cutoffs).filter("kept").select("row.*")
