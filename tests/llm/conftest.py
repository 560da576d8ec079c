import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside.
CLASHES = ("key", "node", "words", "found", "extra", "m", "spans", "start", "kind", "label", "size")


@pytest.fixture(scope="session")
def docs(spark):
    """Real documents."""
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows(spark):
    """Nulls in any column, empty and blank texts, repeated rows and ids, a very long text."""
    long = " ".join(f"w{i * 7919 % 60013}x{i % 31}" for i in range(60_000))
    rows = [(None, None, None, None, None), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (None, "some words of a row without any id at all", "en", None, None), (4, "one two three four", "de", "b", 18), (4, "one two three four", "de", "b", 18), (4, "another text with the same id as the two before it", "de", "b", 50), (5, long, "en", "a", len(long)), (6, "x" * 200_000, "fr", "a", 200_000), (7, "😀 ÿ é ñ ß   \x85 naïve", "fr", "c", 20)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def odd(spark):
    """odd_rows() with further columns whose names the operators also use."""
    return odd_rows(spark).withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.limit(0)
