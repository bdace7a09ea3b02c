import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, fp string, digest string, count string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, columns whose names operators use themselves."""
    long = " ".join(f"word{k % 977} lies" for k in range(60_000))
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", None, "a"),
        (4, "Hello", "en", None),
        (5, "hello", None, "b"),
        (6, "HELLO there", "en", "b"),
        (7, long, "en", "a"),
        (8, long.upper(), None, "a"),
        (9, "one two three four five", "en", "\U0001f600"),
        (9, "one two three four five", "en", "\U0001f600"),
        (10, "Ünïcode ÀÉ 漢字 <|endoftext|> 'tis  x y\r\n12 34", "de", "z"),
        (11, "123 456 789", "fr", "z"),
        (None, "no id here", None, None),
        (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, None, "s", "h", "f", "d", "c") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
