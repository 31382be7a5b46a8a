import pytest

LONG = "word " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank, long, repeated and foreign texts, null and repeated keys,
    and extra columns whose names the operators use inside."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, LONG), (7, "The cat sat on the mat. It was the best of mats! Was it?\nYes."), (8, "The cat sat on the mat. It was the best of mats! Was it?\nYes."),
        (9, "漢字とかな 한국어 русский текст"), (10, "a  b c\x1fd\x85e 😀 <|endoftext|>"), (None, "The key is null here."), (None, None), (11, "repeated row"), (11, "repeated row"), (12, "first text of a key"), (12, "second text of a key"), (13, "!!! ??? ..."),
    ]
    df = spark.createDataFrame([(*r, None, "x", 1, "y", 2) for r in rows], "doc_id long, text string, lang string, id string, n int, s string, part int")
    return df


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
