import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with clashing names."""
    long_text = " ".join(f"w{i % 977}x{i % 13} the" for i in range(30_000)) + "\n" + "same line " * 9 + "\n" * 50
    rows = [
        (1, "Plain words of a text, said again.\nPlain words of a text, said again.", "en", "a", 10),
        (1, "Plain words of a text, said again.\nPlain words of a text, said again.", "en", "a", 10),
        (1, "another text under the same id <|endoftext|> x", "en", None, None),
        (2, None, "fr", "a", 0), (3, "", None, "b", None), (None, "a text without an id", "en", None, 5), (None, None, None, None, None),
        (4, long_text, "de", "a", len(long_text)), (5, " \t\x0b\n\r\n ", "de", "a", 3), (6, "12 34 ## %% \x1c ​ é ́ ﬁ İ 語", "es", "b", 3), (7, "ein wort", None, "b", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("part", "length", "_n", "_rank", "key", "kept", "_drop", "ids"):
        df = df.withColumn(name, df.doc_id)
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
