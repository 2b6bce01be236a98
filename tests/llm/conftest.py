import pytest

LONG = "Word number %d stands here, and more follow. "


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = "".join(LONG % i for i in range(9000))
    rows = [
        (None, "alone without an id", "x", 1), (1, None, None, None), (2, "", "y", 2), (3, "the same words again and again", "y", 3),
        (3, "the same words again and again", "y", 3), (4, long, "z", 4), (5, long + "one more", "z", 5), (6, "é ß ́ 漢字 😀\t\x00 end", None, 6),
        (7, 'token = "9f86d081884c7d659a2feaa0c55ad015" and MIT License', "s", 7), (8, "the same words again and again", "t", 8),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, shard string, hits int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
