"""The fast encoder gives the ids of the full one, around and beyond the run of white space it can't take."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from subtide.llm import packing


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("unit", [" ", "\t", "\n", " ", "　", " \n", "a", "7", "!", "ab ", "é"])
def test_runs_around_the_limit(full, unit):
    encode = packing.encoder()
    for n in (packing.LONG_RUN - 1, packing.LONG_RUN, packing.LONG_RUN + 1):
        for text in ((unit * n)[:n], "x" + (unit * n)[:n] + "y", (unit * n)[:n] + " <|endoftext|>"):
            assert encode([text]) == [full.encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize("unit", [" ", "\n", "\t"])
def test_millions_of_white_space(full, unit):
    for n in (1_000_000, 5_000_000):
        text = unit * n + "x"
        assert packing.encoder()([text, "a b"]) == [full.encode(t, add_special_tokens=False).ids for t in (text, "a b")]


def test_run_search_takes_linear_time():
    assert not packing.has_long_run((" " * (packing.LONG_RUN - 1) + "x") * 50)
    assert packing.has_long_run("x" * 1_000_000 + " " * packing.LONG_RUN)
    assert not packing.has_long_run((" " * 99 + "x") * 50_000)


def test_special_strings_as_plain_text(full):
    plain = packing.encoder(plain_specials=True)
    text = "a <|endoftext|> b"
    assert packing.encoder()([text]) != plain([text])
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for t in (text, text + " " * packing.LONG_RUN + "x"):
        assert plain([t]) == [other.encode(t, add_special_tokens=False).ids]


def test_packing_a_text_of_blanks(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "a b")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {1: 1_000_001, 2: 3}
