import pytest

LONG = "lorem ipsum dolor sit amet " * 12_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, h long, score double, size long, n int"


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, 0, "r", 1, 2, 0.5, 3, 4)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts, languages and sources, empty and very long texts, repeated rows, and columns
    with names that the operators use inside."""
    rows = [doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, LONG), doc(5, "one two"), doc(5, "one two"), doc(None, "no id here"), doc(None, None), doc(6, "one two", None, None), doc(7, "é😀 x", "fr", ""), doc(None, "no id here"), doc(8, "12345 !!!", None, "t")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
