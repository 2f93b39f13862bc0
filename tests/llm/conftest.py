import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000  # over 1 MB
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score double, weight int, rid string, line string, `a b` string"


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, None if text is None else len(text), "x", 0.5, 1, "r", "l", "q")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with NULLs in every column, empty, blank and very long texts, ties, repeated rows and clashing names."""
    same = "The quick brown fox jumps over the lazy dog near the river bank today. " * 4
    rows = [
        row(1, same), row(2, same), row(3, None), row(4, ""), row(5, " \n\t "), row(6, LONG), row(7, "word"), row(8, "é è 漢字 ñ"),
        row(None, same), row(None, "no id here but some words anyway"), row(1, same), (None,) * 11, row(9, "a\x00b \x0b\x0c c", None), row(10, "x" * 300_000),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    """Labels with NULLs, repeats, unknown ids and a clashing column."""
    return spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 0, "x"), (2, 0, 1, "x"), (None, 1, 1, "x"), (3, None, None, None), (7, 0, 1, "y"), (99, 1, 0, "z")], "doc_id bigint, quality int, toxic int, text string")
