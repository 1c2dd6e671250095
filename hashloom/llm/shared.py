"""What the operators share: bounded batches and stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hashloom.sources.scratch import stored  # noqa: F401  (the operators import it from here)

#: Bytes of one Arrow batch that goes to a Python worker (a single longer row is a batch of its own).
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame, with Arrow batches bounded in bytes and not in rows only: a setting of the session, which stays for the caller's other queries."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents."""
    return bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"))
