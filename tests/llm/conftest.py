import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again " * 6, "en", "a", 10),
        (1, "the quick brown fox jumps over the lazy dog again and again " * 6, "en", "a", 10),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (None, "no id here but some words\nand two lines", "en", "b", 5),
        (None, None, None, None, None),
        (5, long, "de", "b", None),
        (6, "   \n\t ", "fr", None, 6),
        (7, "don't  stop <|im_end|> é漢字   x y", "fr", "c", 7),
        (2, "", "en", "a", 0),
        (8, "one", "fr", "c", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = {c: c for c in ("score", "size", "taken", "kept", "n_words", "lang_pred", "node", "class_id", "target", "content", "row", "x", "key", "lines")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in extra})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
