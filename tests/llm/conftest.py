import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators might use."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t\n ", "en", "a", 7),
        (4, long, "en", "a", len(long)),
        (5, "Some plain words stand here, and no more.", None, None, 41),
        (5, "Some plain words stand here, and no more.", None, None, 41),
        (5, "Another text with the same id as the one above.", "en", "b", 46),
        (None, "A text without an id, in a row of its own.", "en", "b", 42),
        (None, "A text without an id, in a row of its own.", "en", "b", 42),
        (None, None, None, None, None),
        (9, "12345 !!! ??? \U0001f642", "en", "c", 15),
        (10, "x" * 5000, "de", "c", 5000),
    ]
    df = spark.createDataFrame(rows, DOC)
    for name in ("score", "size", "key", "part", "id", "h", "shards", "fp", "count", "bucket", "host"):
        df = df.withColumn(name, df["n_chars"])
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


