from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, n string, fp string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    words = " ".join(f"word{i}" for i in range(30))
    long = "alpha beta gamma delta epsilon\n" * 3000
    rows = [
        (1, words, "en", "a", len(words)),
        (2, words, "en", "a", len(words)),
        (2, words, "en", "a", len(words)),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (None, words + " x", "de", "b", 1),
        (None, None, None, None, None),
        (7, long, "en", None, len(long)),
        (8, "a" * 50_000, "en", "b", 50_000),
        (9, " \t\n", "fr", "b", 3),
        (10, "Ünï cödé 😀 " * 40, "fr", "", 5),
        (11, "mail a@b.co now " * 12, "en", "a", 6),
        (12, "one two three", "en", "a", 7),
        (13, " " * 1_200_000 + "end", "en", "b", 1_200_003),
        (14, "\n\t" * 300_000, None, "a", 600_000),
    ]
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
