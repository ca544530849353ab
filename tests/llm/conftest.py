import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, id int"

#: Nulls, empty and blank texts, ties, repeated rows, clashing column names, special strings, other scripts.
EDGE = [
    (1, None, None, None, None, "x", 1),
    (2, "", "en", "a", 0, "x", 1),
    (3, "same  text\nhere", "en", "a", 1, "x", 1),
    (4, "same\ttext here", "en", None, 1, None, 2),
    (4, "same\ttext here", "en", None, 1, None, 2),
    (5, "<|endoftext|> and <|endoftext|>", "en", "a", 1, "x", 3),
    (None, "same text here", "en", "a", 1, "x", None),
    (None, None, None, None, None, None, None),
    (7, "日本語のテキスト ①②   naïve — 😀😀 don't I'LL  \r\n\x0b x", "fr", "b", 1, "x", 4),
    (8, "1234 567 !!!", None, "b", 1, "x", 5),
    (9, " \n \t ", "en", "b", 1, "x", 6),
    (10, "word " * 30000, "en", "b", 150000, "x", 7),
    (11, "a\x00b \x1c\x85 c", "en", "b", 1, "x", 8),
    (-3, "ét́ ʼn ﬁ", "fr", "b", 1, "x", 8),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return {r.doc_id: r for r in docs.collect()}
