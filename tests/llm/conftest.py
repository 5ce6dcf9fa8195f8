import random

import pytest


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents-like frames from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows, extra=False):
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string")
        clash = [(i, t, 7, "x", 1.5, 3) for i, t in rows]
        return spark.createDataFrame(clash, "doc_id long, text string, n_words long, kept_text string, score double, sequence_id long")

    return make


@pytest.fixture(scope="session")
def texts():
    """Odd texts: null, empty, white space, one word, ties, repeats, odd spaces, very long."""
    rng = random.Random(4)
    base = words(rng, 60)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, base), (6, base), (7, base + " tail"), (8, words(rng, 25)), (9, "a b c d  e"), (10, "<|endoftext|> it's DON'T 12 \x1c x"),
        (11, words(rng, 30_000, 500)), (12, "x" * 70_000), (5, base), (None, base + " other words here"), (None, None), (13, "Ünïcode ẞtraße žluťoučký 日本語 😀 " * 5),
    ]
