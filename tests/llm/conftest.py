import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, label int, words string, print string, text_hash string, copies int, component_id int"


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    long = "alpha beta gamma delta " * 20_000
    texts = [(1, "one two three four"), (1, "one two three four"), (2, ""), (3, None), (None, "no key here at all"), (None, None), (4, long), (5, "x" * 100_000), (6, " \t\n "), (7, "Größe ▁ 日本語 \U0001f600 \u0000 end"), (8, "one two three four")]
    rows = [(k, t, None if k is None else "en", None, None if t is None else len(t), "k", 1, "w", "p", "h", 2, 3) for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
