import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, size=9):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, size))) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from texts, with ids from 0 or as given."""

    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        return spark.createDataFrame([(i, t, g, "src0", None) for i, t, g in zip(ids, texts, langs, strict=True)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, very long and non-Latin texts."""
    return [None, "", " \n\t", "one", "one", words(1, 40), words(1, 40), words(2, 30_000), "ünï ß 漢字 😀 é", "a" * 50_000, "x\ny\n\nz", "<|endoftext|> it's 12"]
