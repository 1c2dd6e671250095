"""op8: the language of every document."""

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm.langid import identify

NAME = "op8_language_id"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
