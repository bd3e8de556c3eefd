"""Token alignment against a direct version that encodes each whole text by itself."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from subtide.llm import alignment
from tests.conftest import SF_DIR

UNITS = {c: b for b, c in enumerate(map(chr, range(256))) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
UNITS |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in UNITS.values())}


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text, libraries):
    first, second = libraries
    if not text:
        return [], []
    a = first.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(UNITS[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
    b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, second.id_to_piece(i)) for i in second.encode(text))]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def direct(rows, libraries):
    """The contract's rows from (doc_id, text)."""
    made, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text, libraries)
        ends = []
        for side in (a, b):
            at, found = 0, {}
            for place, (i, spelled) in enumerate(side):
                at += len(spelled)
                found[at] = (place, i)
            ends.append(found)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(ends[0][e][1], ends[1][e][1]) for e in shared]
        groups, at = [], [0, 0]
        for e in shared:
            cut = []
            for k, side in enumerate((a, b)):
                place = ends[k][e][0] + 1
                cut.append(",".join(str(i) for i, _ in side[at[k] : place]))
                at[k] = place
            groups.append("|".join(cut))
        counts.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        made.append((doc_id, len(a), len(b), len(groups), links, digest))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, digest in made:
        n_best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((doc_id, n_a, n_b, n_groups, len(links), n_best, sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def found(df, **options):
    result = alignment.align_corpus(df, **options)
    assert result.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [t for _, t in result.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in result.collect()), key=repr)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


STRANGE = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b c", "\n", "a\n b", "a \nb", "\t\tx", "x▁y", "▁", "ok x▁y ok",
    "<s> </s> <unk> <0x41>", "<|endoftext|> x <|endoftext|>", "don't we'll 's it 'll", "1234567 89 a1b2", "日本語 テキスト です",
    "😀😀 👨‍👩‍👧 x", "é ﬁ ① Å", "\x00 \x01\x02", "a b c d e　 f", "   ", "!?!?.. -- __ __x", "ÄÖÜ ß straße",
    "word " * 50, "x" * 3000, " " * 3000 + "x", "a\r\n\r\nb\r c", "\u0085 x  y", "tab\tand space",
]


def test_against_whole_texts(spark, libraries):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert found(given) == direct(texts(given), libraries)


def test_strange_texts(spark, libraries):
    draw = random.Random(11)
    rows = [*STRANGE, *STRANGE[:5]]
    pieces = [" ", " ", "  ", "\n", "a", "é", "1", "!", "'s", " ", "word", "日", "́", "_", "😀", "　", "\t", "<s>"]
    rows += ["".join(draw.choices(pieces, k=draw.randint(1, 40))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df) == direct(rows, libraries) == found(df, broadcast=0)


def test_odd_rows(odd_documents, no_documents, libraries):
    assert found(odd_documents) == direct(texts(odd_documents), libraries)
    assert found(no_documents) == []


def test_a_task_may_forget_parts(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    monkeypatch.setattr(alignment, "SLICE", 50)
    parts = alignment.Parts(alignment.A, alignment.B)
    for _ in range(3):
        for text in STRANGE:
            n_a, n_b, n_groups, n_links = (c[0].as_py() for c in alignment._aligned(parts, [text])[:4])
            a, b = tokens(text, libraries)
            assert (n_a, n_b) == (len(a), len(b)) and n_links == n_groups


def test_a_very_long_text(spark, libraries):
    rows = [(1, " " * 1_200_000 + "x"), (2, "long word " * 150_000), (3, "\n" * 300_000), (4, "ab" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == direct(rows, libraries)


def test_intervals_are_coalesced():
    starts, ends, kinds = np.array([0, 3, 5, 0, 2, 5, 6]), np.array([3, 5, 9, 2, 5, 6, 9]), np.array([0, 0, 0, 1, 1, 1, 1])
    order, group = alignment.coalesced(starts, ends, kinds)
    assert [(int(starts[i]), int(kinds[i]), int(g)) for i, g in zip(order, group)] == [
        (0, 0, 0), (0, 1, 0), (2, 1, 0), (3, 0, 0), (5, 0, 1), (5, 1, 1), (6, 1, 1),
    ]
