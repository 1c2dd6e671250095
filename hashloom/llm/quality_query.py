"""op9: a quality score for every document."""

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm.quality import score

NAME = "op9_quality"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
