import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = [
    "the quick brown fox jumps over the lazy dog while the rain falls on the quiet town",
    "a second document about something else entirely with words that nobody repeats here",
    "le petit chat dort sur la table pendant que la pluie tombe sur la ville tranquille",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, clashing extra columns."""
    rows = [
        (1, PROSE[0], "en", "a", 1),
        (2, PROSE[1], "en", "a", 2),
        (3, PROSE[2], "fr", "b", 3),
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (6, " \t\n ", "en", None, 4),
        (None, PROSE[0] + " again", "en", "a", 5),
        (7, PROSE[0], "en", "a", 1),
        (7, PROSE[0], "en", "a", 1),
        (8, "\n".join([PROSE[1]] * 3), None, "b", 6),
        (9, "word " * 60_000, "en", "a", 7),
        (10, "İSTANBUL ÉCLAIR Ⅷ", "fr", "b", 8),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def odd_extra(odd_docs):
    """The same with columns named as operators might name theirs."""
    from pyspark.sql import functions as F

    clashing = ("n", "k", "h", "key", "kept", "words", "at", "label", "a.b")
    return odd_docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clashing)))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))
