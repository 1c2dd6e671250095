import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "Lorem ipsum dolor sit amet consectetur " * 3000


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, repeated rows, no letters, and columns whose names operators use inside."""
    texts = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, LONG), (6, LONG), (6, LONG), (7, "!!! ... ???"), (8, "é" * 500 + " ß İ 漢字 😀 \x00 end"), (None, "no id here but some words"), (9, "x" * 5000), (10, "<|endoftext|> and <|startoftext|> token=abcdef123456")]
    rows = [(i, t, None if k % 3 == 0 else "en", None, None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(c) for c in ("n", "id", "key", "run", "bucket", "score", "n_words", "rep", "label", "row")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
