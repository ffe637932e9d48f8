from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    base = " ".join(rng.choice(words) for _ in range(80))
    near = base.replace(" ", "  ", 1).upper()
    edited = " ".join(base.split()[:-1] + ["other"])
    long = "\n".join(" ".join(rng.choice(words) for _ in range(50)) for _ in range(800))
    rows = [
        (1, base, "en", "a", 1), (2, near, "en", "a", 1), (3, edited, "de", "b", 1), (4, long, "fr", "b", 1), (5, None, None, None, None),
        (6, "", "en", "c", 0), (7, " \t\n ", "en", "c", 4), (8, "one two", "es", None, 7), (9, "One\ttwo", "es", "a", 7), (None, "no id here at all", "en", "a", 1),
        (10, base, "en", "a", 1), (10, base, "en", "a", 1), (11, "é𐀀 ß日本語 Ünï   x", "fr", "d", 9), (12, "word " * 40, "en", "a", 200),
    ]
    return rows + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 120))), rng.choice(["en", "de"]), rng.choice("abc"), 1) for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(odd):
    """Columns whose names clash with what the operators use inside."""
    from pyspark.sql import functions as F

    extra = ["score", "n", "node", "block", "key", "h", "size", "template", "matches", "spans", "items", "label", "value", "word", "gram", "chunk", "n_words", "kept", "held_out", "predicted", "_text", "stratum", "copies", "want"]
    return odd.select("*", *[F.lit("x").alias(c) for c in extra])
