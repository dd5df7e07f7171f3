import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (6, "ünï çödé 東京 🙂 ﬁ ①"), (7, "a b c " * 4000), (8, "x" * 30000), (None, "lost"), (9, "a b c " * 4000),
    (4, "word"), (10, "same words in here again and again, twice over now\n" * 3), (11, "Same words in here again and AGAIN, twice over now\n" * 3), (12, "  nbsp em\x1cfs"),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty, long, repeated and odd texts, with columns whose names an operator might want for itself."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, None) for i, t in ODD], "doc_id long, text string, lang string, source string, quality int, n long, _id string")
