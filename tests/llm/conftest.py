import random

import pytest

TEXTS = [None, "", " ", "\n\t\n", "word", "Word  word", "a" * 5000, "ab " * 900, "x" * 199, "y" * 200, "é" * 150, "🏔 mountain " * 40]


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of texts, with repeated rows, a null id and columns of clashing names."""
    def make(texts):
        rows = [(i, t, "en", "src0", len(t or ""), "x", 1, "c", 7) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, shard int, content string, n_bytes long").repartition(3)
    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded invented prose."""
    def make(n, seed=3, words=120):
        r = random.Random(seed)
        stock = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
        return [" ".join(r.choice(stock) for _ in range(words)) for _ in range(n)]
    return make


@pytest.fixture
def edge_texts():
    return list(TEXTS)
