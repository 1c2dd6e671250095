"""op6: secrets in every document."""

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm.secret_scan import scan

NAME = "op6_secret_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_novel")
