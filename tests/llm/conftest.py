import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, 7), (2, "", "en", "s", 0, None), (3, " \n\t ", "en", "s", 3, 1), (4, "one two three", "en", "s", 13, 1), (4, "one two three", "en", "s", 13, 1), (5, "ONE two three", "en", "s", 13, 1),
        (None, "a text without an id but with some words", "en", None, 40, 1), (6, long, "en", "s", len(long), 1), (7, long + " end", "en", "s", len(long) + 4, 1), (8, "héé 😀 'll <|endoftext|> x", "en", "s", 27, 1), (9, "x" * 3000, "en", "s", 3000, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").withColumnRenamed("score", "key")
