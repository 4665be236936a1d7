import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with nulls, empties, ties, repeated rows, copies and a column that no operator asks for."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word30", "other")
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, near, "de", None), (4, None, None, "b"), (5, "", "en", "b"), (6, " \t\n", "en", "b"), (7, "one two", "de", "c"), (8, "ONE two", "de", "c"), (None, "lonely text of five words", "fr", "c"), (9, "same row", "fr", "a"), (9, "same row", "fr", "a"), (10, "x y z\n" + base + "\ntail", "en", "d"), (11, "été ß " * 3000, "fr", "d")]
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, lang string, source string, node int")
