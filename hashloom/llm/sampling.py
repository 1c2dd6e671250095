"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(key: Column | str, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % by


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled doc_ids, those whose hash is least; all rows of each.

    ``labels`` holds the rows that may be learned from. What is broadcast is
    these ids and labels only, so its size is bounded by ``bound``.
    """
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")


def at_most(rows: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` of the (doc_id, text, label) rows, whatever ids repeat: each text of an id once, those whose hashes are least."""
    return rows.dropDuplicates(["doc_id", "text"]).orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(bound)
