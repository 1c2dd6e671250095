"""op3: the tokens of every document, and back."""

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm.bpe_codec import digests

NAME = "op3_bpe_codec"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
