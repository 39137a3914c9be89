import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, score double, label string, hash long"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma,", "delta.", "der", "über", "straße", "ñandú", "eta", "theta", "iota"]
    long_text = prose(rng, 30_000, vocabulary)
    rows = [
        (1, "One two three four five six.\nSeven eight.", "en", "a", 0.5, "x", 1),
        (2, "One two three four five six.\nSeven eight.", "en", "a", 0.5, "x", 1),
        (2, "One two three four five six.\nSeven eight.", "en", "a", 0.5, "x", 1),
        (3, "", "de", "b", None, None, None),
        (4, None, None, None, None, None, None),
        (None, "a text without id", "en", "a", 0.1, "y", 2),
        (None, None, None, None, None, None, None),
        (5, "word", "fr", "c", 1.0, "z", 3),
        (6, "   \n\t ", "fr", "c", 1.0, "z", 3),
        (7, long_text, "de", "c", 1.0, "z", 3),
        (-8, "12345 67 !! ?? 😀 ǅ", "es", "c", 1.0, "z", 3),
        (1 << 40, "x\u0000y <|endoftext|> ½ ² z", "es", "c", 1.0, "z", 3),
    ]
    return rows + [(100 + i, prose(rng, rng.randrange(1, 80), vocabulary), "en", "d", 0.0, "w", i) for i in range(40)]


@pytest.fixture
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
