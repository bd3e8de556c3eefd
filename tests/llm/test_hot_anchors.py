"""Passages shared by many documents with different neighbours: taken apart, equal to brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from subtide.llm import suffix_dedup
from tests.llm.test_operators import without_repeats


def cut(df, **settings):
    return sorted((r.doc_id, r.kept) for r in suffix_dedup.remove_repeats(df, **settings).collect())


def noise(draw, n):
    return "".join(draw.choices("abcdefghij klmnop", k=n))


@pytest.fixture(scope="module")
def shared(spark):
    """A 40-byte and a 90-byte passage in most documents, each time between other words; some copies."""
    draw = random.Random(12)
    short, long_ = noise(draw, 40), noise(draw, 90)
    rows = [(i, noise(draw, 60) + draw.choice([short, long_, long_ + short]) + noise(draw, 45)) for i in range(300)]
    rows += [(1000 + i, rows[draw.randrange(300)][1]) for i in range(60)] + [(None, short * 4), (5, None), (6, "")]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


def test_same_rows_however_many_anchors_are_hot(shared):
    rows = [(r.doc_id, r.text) for r in shared.collect()]
    want = sorted(((d, kept) for d, _, _, kept in without_repeats(rows)), key=repr)
    import hashlib

    for settings in ({"hot": 0}, {"hot": 3}, {"hot": 50, "fill": 100}, {}):
        found = suffix_dedup.remove_repeats(shared, **settings).collect()
        assert sorted(((r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in found), key=repr) == want


def test_a_hot_anchor_leaves_no_large_group(shared, tmp_path):
    """With the limit, an anchor's strings in a part are few; without it the passage's are hundreds."""

    def largest(hot):
        folder = str(tmp_path / str(hot))
        suffix_dedup._find_anchors(shared, folder, 2, hot)
        strings = {}
        for batch in shared.select("doc_id", "text").toArrow().to_batches():
            texts, doc, hashes, first, count = suffix_dedup._repeated(batch, folder, 2)
            for d, h, a, n in zip(doc.tolist(), hashes.tolist(), first.tolist(), count.tolist()):
                strings.setdefault(h, set()).add(texts[d][a : a + n + suffix_dedup.LENGTH - 1])
        return max(map(len, strings.values()))

    assert largest(10**6) > 80
    assert largest(20) <= 20


def test_key_tells_stretches_of_an_anchor_apart():
    draw = random.Random(3)
    passage = noise(draw, 45)
    texts = [(noise(draw, 30) + passage + noise(draw, 30)).encode() for _ in range(200)]
    doc, hashes, first, count, key = suffix_dedup._stretches(texts)
    strings = {(h, texts[d][a : a + n + 49]) for d, h, a, n in zip(doc.tolist(), hashes.tolist(), first.tolist(), count.tolist())}
    assert len(np.unique(key)) == len(strings)
    assert (key >> np.uint64(24) == hashes >> np.uint64(24)).all()
