import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, score double, fp string, wid long, pos long, label int, component string"


def rows_of(texts):
    """Documents with extra columns that are named like the operators' own."""
    return [(i, t, None if i is None or i % 7 == 0 else "en", None if i is None or i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "h", 1.5, "f", 1, 2, 3, "c") for i, t in texts]


@pytest.fixture
def make(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture
def edge_texts():
    """Nulls, blanks, one word, a very long text, ties, a repeated row and two rows of one doc_id."""
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "délta", "eps-1", "ζήτα", "eta", "theta"]
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(60_000))
    body = " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(120))
    return [(1, body), (2, None), (3, ""), (4, " \n\t "), (5, "word"), (6, long), (7, body), (7, body), (8, body + " tail"), (8, "other text\nother text\nlast"), (9, body.upper())]
