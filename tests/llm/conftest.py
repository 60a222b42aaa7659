import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, keys string, `found` string, id string, media string"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and extra columns whose names operators use inside."""
    base = " ".join(words(120, 1))
    long = " ".join(words(60_000, 2))
    rows = [
        (1, base, "en", "a", 1), (2, None, "en", None, None), (None, base, "en", "a", 1), (3, "", None, "a", 0), (4, base, "fr", "a", 1), (4, base, "fr", "a", 1),
        (5, long, "en", "a", 1), (6, "!!! ... ---", "en", "a", 1), (7, "x", "en", "a", 1), (8, "", "en", "a", 0), (9, "a" * 50_000, None, None, None), (10, "Ünïcode 漢字 тест mail me.1@x.org", "de", "a", 1),
        (None, None, None, None, None),
    ]
    return spark.createDataFrame([(*r, "b", "k", "f", "i", "m") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def stored_tables(spark):
    from pagemill.llm import common

    yield
    common.clear_stored()
