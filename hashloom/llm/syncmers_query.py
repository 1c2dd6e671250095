"""op2: fingerprints of every document and of its edited text."""

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm.syncmers import edit_likeness

NAME = "op2_syncmer_fingerprints"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
