"""op5: the number of tokens of every document."""

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm.token_counts import count_tokens

NAME = "op5_token_counts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
