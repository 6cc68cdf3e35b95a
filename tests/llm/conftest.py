import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, label int, node long, key long"


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank texts, one very long text, repeated rows, columns with clashing names."""
    long_text = " ".join(f"word{i % 997} and{i}" for i in range(30_000))
    tie = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, tie, "en", "b", 9), (4, tie, "en", "b", 9), (5, tie.upper(), None, "b", 9), (None, tie, "en", None, 9), (6, long_text, "en", "c", 1), (7, "é 中\U0001f600 mit license", "fr", "", 4), (8, "x" * 5000, "en", "a", 5000), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 0.5, 1, 1, 1, 1) for r in rows], ODD)


@pytest.fixture
def nothing(odd):
    return odd.limit(0)
