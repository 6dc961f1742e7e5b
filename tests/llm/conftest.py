import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, label string, row string, fp string"

#: Nulls everywhere, empty texts, repeated rows, ties, a very long text, columns with clashing names.
LONG = " ".join(f"w{i % 1013}" for i in range(60_000))
ODD_ROWS = [
    (1, "the cat sat on the mat and the dog sat on the log", "en", "a"),
    (1, "the cat sat on the mat and the dog sat on the log", "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, " \t\n", "de", "a"),
    (5, "x", "de", "b"),
    (6, LONG, "en", "b"),
    (None, "der hund und die katze sind in dem haus", "de", None),
    (None, None, None, None),
    (8, "der hund und die katze sind in dem haus", "de", "c"),
    (9, "12 34 !!", "en", "c"),
    (10, "中文 字 <|endoftext|> é", "zh", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), "s", "l", "r", "f") for r in ODD_ROWS]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (5, None, None), (8, 1, 1), (None, 1, 1), (6, 0, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def larger(spark):
    """Documents and labels enough to learn from."""
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
