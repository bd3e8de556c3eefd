"""The divergence audit against a direct count, with forced digest collisions, many sources and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from subtide.llm import divergence
from tests.conftest import SF_DIR

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct(rows, min_docs=30, top=50):
    """The contract's rows from (text, lang, source)."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, c in docs[lang].items() if c >= min_docs)
        v = len(kept)
        counts = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(counts[s][t] for s in sources) for t in kept}

        def shares(c, v=v):
            total = sum(c.values())
            return {t: 1 + 10**9 * (k + 5) // (total + 5 * v) for t, k in c.items()}

        p, q = {s: shares(counts[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            order = lambda x: (-x[0], x[1].encode())
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=order)[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def found(df, **options):
    result = divergence.source_divergence(df, **options)
    assert result.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(tuple(r) for r in result.collect())


def texts(df):
    return [(r.text, r.lang, r.source) for r in df.select("text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def made(spark):
    """Terms of many lengths in 130 sources of one language and few of others, with ties."""
    draw = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("x", "Xy", "é", "ß", "日本", "Ü", "q")]
    rows = []
    for i in range(900):
        picked = draw.choices(words[: draw.choice((20, 140))], k=draw.randint(1, 30))
        rows.append((" 1,".join(picked), draw.choice(("en", "en", "en", "de")), f"s{i % 130}"))
    rows += [("only once here", "fr", "a"), ("none", "fr", "b"), ("12 34", "it", "z")]
    return rows, spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)


def test_against_direct_counts(spark, made):
    assert found(made[1]) == direct(made[0])
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert found(given) == direct(texts(given))


@pytest.mark.parametrize("bits", [1, 4])
def test_colliding_digests_are_split(made, bits):
    assert found(made[1], bits=bits, min_docs=3, top=5) == direct(made[0], 3, 5)


def test_small_blocks_slices_and_flushes(made, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 7)
    monkeypatch.setattr(divergence, "TERMS", 10)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    assert found(made[1], min_docs=3) == direct(made[0], 3)


def test_more_terms_than_are_broadcast(made, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST", 5)
    assert found(made[1], min_docs=3) == direct(made[0], 3)
    assert found(made[1], min_docs=3, bits=4) == direct(made[0], 3)


def test_odd_rows(odd_documents, no_documents):
    for least in (1, 2, 30):
        assert found(odd_documents, min_docs=least) == direct(texts(odd_documents), least)
    assert found(no_documents) == []


def test_large_counts_stay_exact(spark):
    rows = spark.sql("SELECT 9000000000000 AS n, 3000000000 AS total, 7 AS v")
    got = rows.select(divergence._share("n", "n * 3 + total", "v")).first()[0]
    assert got == 1 + 10**9 * (9 * 10**12 + 5) // (27 * 10**12 + 3 * 10**9 + 35)


def test_counts_are_shuffled_at_fixed_width(made):
    numbered = divergence.with_numbers(made[1], divergence.numbered_groups(made[1]))
    stored = divergence.count_terms(numbered)
    plan = stored.groupBy("lang_id", "group_id", "digest").sum("n", "docs")._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "term" not in exchange and "lang#" not in exchange
