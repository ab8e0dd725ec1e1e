"""Small tables that every operator must take: nulls, empties, long texts, ties, repeats, clashing names."""

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and looked at the moon.", "en", 7),
        (2, None, None, None),
        (3, "", "en", 7),
        (4, "  \t\n ", "xx", 7),
        (5, long, "en", 7),
        (5, long, "en", 7),
        (None, "no id here, but words", None, 7),
        (None, "no id here, but words", None, 7),
        (6, "ÜBER die Brücke ging ÉLAN vite", "de", 7),
        (7, "12 345 !!", None, 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
