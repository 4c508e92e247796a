import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, _text string, rank int"


def _row(i, text, lang="en", source="s0", extra="x"):
    return (i, text, lang, source, None if text is None else len(text), extra, extra, extra, 7)


LONG = " ".join(f"word{i % 977} lorem{i % 31}" for i in range(60_000))
BODY = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old tall tree at night"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties,
    repeated rows, and extra columns whose names clash with internal ones."""
    rows = [_row(1, None), _row(2, ""), _row(3, " \n\t "), _row(4, LONG), _row(5, BODY), _row(6, BODY),
            _row(6, BODY), _row(7, BODY.upper(), None, None), _row(None, BODY, None, "s1"), _row(8, "one two", "de", "s1"),
            _row(9, "one two", "de", "s2"), _row(10, BODY + " ending", "fr", None), (11, *[None] * 8)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 0), (5, 0, 1), (8, 0, 1), (9, None, None), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
