import pytest

TEXTS = [
    "", None, "one", "one two three four five six seven eight nine ten", "a\na\na\n", "x" * 50_000,
    "mail a.b@c.example.org or +1 (212) 555-1234, ip 10.0.0.1, card 4111 1111 1111 1111",
    "Licensed under the Apache Licence, version 2.0",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns of clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(i, t, "k", 1) for i, t in enumerate([*TEXTS, long, long, long + " tail"])]
    rows += [(3, TEXTS[3], "k", 1), (None, "text without an id here", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 0), (6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
