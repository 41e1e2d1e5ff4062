import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, a shared doc_id."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in the wood today "
    rows = [
        (1, base * 3, "en", "a", 300), (2, base * 3, "en", "a", 300), (2, base * 3, "en", "a", 300), (3, None, "en", "a", None), (4, "", None, None, 0),
        (5, " \n\t ", "en", "b", 4), (6, "x" * 30000, "en", "b", 30000), (7, base + "tail é日本\U0001f600 's 'll it's", "en", "b", 130), (7, "another text of the same id", "en", "b", 27),
        (None, base * 2, "en", "a", 200), (8, "one", "de", "c", 3), (9, "idiot scum worthless " * 12, "en", "c", 250),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    extra = ["id", "key", "tie", "spans", "class", "n", "bucket", "guest", "_host", "_path", "_evidence", "_posterior", "_salt", "score", "component_id", "bytes"]
    return odd.withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
