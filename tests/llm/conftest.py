import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def edge_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long_text = " ".join(f"word{i % 997}" for i in range(20_000))
    lines = "first line of the passage\nsecond line of the passage\nthird line of the passage"
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"), (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a"), (3, "", "en", "b"), (4, "", None, None), (5, None, "en", "b"), (6, long_text, "en", "a"),
        (7, lines, "en", "b"), (8, f"head\n{lines}\ntail", "en", "b"), (9, "short", None, "c"), (10, "\n\n\n\n", "en", "c"), (None, "no id here", "en", "c"), (11, "日本語 \U0001f999 ▁ x", "ja", "c"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows], DOCS)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
