import pytest

LONG = "wörd and the thing of it was said to be. " * 4000


@pytest.fixture(scope="session")
def edge_rows():
    """Null keys and texts, empty and long texts, ties, repeated rows, few words, a column whose name clashes."""
    texts = [None, "", " \n\t", "x", "one two", "the quick brown fox jumps over the lazy dog near the old mill", LONG, LONG + "tail", "1234 5678 !!", "日本語 のテキスト です", "a" * 5000, "mail a.b@c.de or +49 30 1234567, 10.0.0.1"]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", len(t or ""), f"k{i}") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (5, "another text under a number that is taken already", "de", "s1", 49, "z"), (None, "no number at all", "en", None, 16, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
