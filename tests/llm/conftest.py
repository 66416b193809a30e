import pytest

LONG = "word " * 60_000
ROWS = [
    (1, "one two three four five six", "en", "a", "x"),
    (1, "one two three four five six", "en", "a", "x"),
    (2, None, "en", "a", None),
    (3, "", None, None, "x"),
    (None, "line\nline\nline\nline\nline\nline", "de", "b", "x"),
    (5, LONG, "en", "b", "x"),
    (6, "ONE two three four five six", "en", "b", "x"),
    (7, "12345 ... !!!", "fr", "c", "x"),
    (8, "\n\n\n\n\n", "fr", "c", "x"),
    (9, " \t ", "fr", "c", "x"),
]
EXTRA = ["row", "id", "tx", "lines", "cuts", "h", "tie", "b", "n", "fp", "fingerprint", "component_id", "keep_id", "kept", "ids", "guess", "spans", "mix_order", "shard", "media", "label", "pos", "stays", "copy", "rng"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = -1")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
