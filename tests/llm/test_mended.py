"""Linear time of the personal-data search, ties of the graph search, links at radius 1."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from subtide.llm import nn_descent, pii, simhash
from subtide.llm.components import connected_components


def test_search_time_grows_with_the_text():
    unit = "mail anna at example dot com or bob@x.org, call plus 1 415 555 0132 or +1 415 555 0199, 10.0.0.1 "

    def seconds(n):
        begin = time.perf_counter()
        base, more = pii.find(unit * n)
        assert len(base) == 3 * n and len(more) == 2 * n
        return time.perf_counter() - begin

    seconds(500)
    small, large = (min(seconds(n) for _ in range(2)) for n in (2000, 16_000))
    assert large < 8 * small * 2.5


def test_covered_spans_equal_the_direct_comparison():
    draw = random.Random(2)
    pieces = ["a@b.co", "a at b dot co", " ", "x", "10.0.0.1", "10 dot 0.0.1", "+1 415 555 0132", "plus 1 four 15 555 0132", ",", "4111 1111 1111 1111", "dot"]
    for _ in range(400):
        text = " ".join(draw.choices(pieces, k=12))
        base, more = pii.find(text)
        normal = pii.normalise(text)
        want = []
        if normal.changed is not None:
            for kind, a, b in pii.detect(normal.text):
                start, end = normal.first[a], normal.last[b - 1]
                if any(normal.changed[a:b]) and not any(k == kind and s <= start and end <= e for k, s, e in base):
                    want.append((kind, start, end))
        assert more == want


def test_ties_go_to_the_smaller_id(spark):
    """300 different vectors have the same product with the query, others more or less."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])]
    order = rng.permutation(np.arange(1, 301))
    rows += [(int(i), [1.0, *map(float, rng.normal(size=3))]) for i in order]
    rows += [(1000 + i, [0.5, *map(float, rng.normal(size=3))]) for i in range(100)]
    rows += [(2000 + i, [1.5 + i, *map(float, rng.normal(size=3))]) for i in range(5)]
    df = nn_descent.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = nn_descent.search(nn_descent.build(df, 21), df.filter("vec_id = 0"), 20).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [2004, 2003, 2002, 2001, 2000, *range(1, 16)]
    assert {r.score for r in found[5:]} == {1.0}


def test_components_at_radius_one(spark):
    draw = random.Random(8)
    values = {24, 25, 16, 9, 0, 2**63, 2**63 + 1}
    for _ in range(60):
        x = draw.getrandbits(64)
        values |= {x, x ^ 1 << draw.randrange(64), x ^ 3 << draw.randrange(62)}
    signed = sorted(simhash._signed(v) for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for radius in (1, 2):
        root = {r.node: r.root for r in connected_components(simhash.links(df, radius)).collect()}
        group = {v: v for v in signed}
        for a in signed:
            for b in signed:
                if 0 < (a ^ b & 2**64 - 1).bit_count() and ((a ^ b) & 2**64 - 1).bit_count() <= radius:
                    low, high = sorted((group[a], group[b]))
                    group = {v: low if g == high else g for v, g in group.items()}
        assert {v: root.get(v, v) for v in signed} == group
    assert simhash.links(df, 1).filter((F.col("u") == 25) & (F.col("v") == 24)).count() == 1
