"""Map changes as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(changes: DataFrame) -> DataFrame:
    """The running map of a stream of (seq, op, key, ptr): each key's last change; state is one row a key."""
    return changes.groupBy("key").agg(F.max_by(F.struct("op", "ptr", "seq"), "seq").alias("last")).select("key", "last.op", "last.ptr", "last.seq")


def windowed_counts(changes: DataFrame, at: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes by time window and kind; windows close when the watermark has passed them."""
    return changes.withWatermark(at, late).groupBy(F.window(at, width), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")


def commit(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch as a version of the log: a folder of its own, so a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
