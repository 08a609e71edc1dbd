import duckdb
import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(sf_dir):
    """(doc_id, text) of every document."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def odd(spark, docs):
    """Nulls, empty and long texts, repeated rows, and columns whose names an operator uses itself."""
    long = "hello wide world " * 8000
    made = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, "!!! 123", "en", "s", 3), (3, "token = abcdef123456 é", "en", None, 3), (None, "some words to keep here around", "en", "s", 3), (None, "some words to keep here around", "en", "s", 3), (4, "one two", "xx", "s", 3)]
    from pyspark.sql import functions as F

    x = spark.createDataFrame(made, docs.schema)
    return x.withColumns({c: F.lit(7) for c in ("n_words", "score", "rep", "key", "start", "h", "parts", "host", "block")})
