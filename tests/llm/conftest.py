import pytest


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows, and an extra column whose name clashes with results."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69, 7),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69, 7),
        (2, None, "en", "a", None, None),
        (3, "", None, None, 0, 1),
        (4, " \t\n ", "de", "b", 4, 1),
        (None, "An orphan text without any id at all", "en", "b", 36, 1),
        (None, None, None, None, None, None),
        (5, "word " * 40_000, "en", "a", 200_000, 1),
        (6, "12345 67890 !!! ???", "fr", "c", 19, 1),
        (7, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "c", 69, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
