"""Versioned key-to-pointer maps as change logs.

A log has the columns (seq, op, key, ptr), op being ``set`` or ``delete``. A
version is a position in the log; the map at a version is each key's last change
up to there. Null pointers are legal values, so whether a key is there is told by
its row and never by its pointer. The last change is an aggregate with map-side
combine, not a window, so a key with very many changes is no burden for a task.
Of several changes of one key with one seq, a set counts before a delete, and the
greatest pointer before others, unless another order is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hashloom.functions import ids


def snapshot(log: DataFrame, version: int | None = None, order: tuple[str, ...] = ("seq", "op", "ptr")) -> DataFrame:
    """(key, ptr, seq) of the map at a version (default: now)."""
    if version is not None:
        log = log.where(F.col("seq") <= version)
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "ptr", "seq"), F.struct(*order)).alias("last"))
    return last.where("last.op = 'set'").select("key", "last.ptr", "last.seq")


def set_all(log: DataFrame, changes: DataFrame, if_absent: bool = False) -> DataFrame:
    """The log with (key, ptr) rows set behind it; ``if_absent``: only for keys the map does not have."""
    if if_absent:
        changes = changes.join(snapshot(log).select("key"), "key", "left_anti")
    return _append(log, changes.select("key", "ptr"), "set")


def delete_all(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with keys deleted behind it; keys the map does not have change nothing (see ``missing``)."""
    there = keys.select("key").distinct().join(snapshot(log).select("key"), "key", "left_semi")
    return _append(log, there.withColumn("ptr", F.lit(None).cast("string")), "delete")


def _append(log: DataFrame, rows: DataFrame, op: str) -> DataFrame:
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    return log.select("seq", "op", "key", "ptr").unionByName(rows.select((last + 1).alias("seq"), F.lit(op).alias("op"), "key", "ptr"))


def missing(view: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that the map does not have."""
    return keys.select("key").distinct().join(view.select("key"), "key", "left_anti")


def require(view: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, ptr) of the keys; an error names a key that the map does not have."""
    found = keys.select("key").join(view.select("key", "ptr", F.lit(True).alias("found")), "key", "left")
    return found.select("key", F.when(F.col("found"), F.col("ptr")).otherwise(F.raise_error(F.concat(F.lit("no such key: "), "key")).cast("string")).alias("ptr"))


def get(view: DataFrame, objects: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, data) of the keys: pointer, then content."""
    pointers = keys.select("key").join(view.select("key", "ptr", F.lit(True).alias("found")), "key", "left")
    loaded = pointers.join(objects.select(F.col("cid").alias("ptr"), "data"), "ptr", "left")
    return loaded.select("key", F.coalesce("found", F.lit(False)).alias("found"), "data")


def exists(view: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that the map has; no content is read."""
    return keys.join(view.select("key"), "key", "left_semi")


def length(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("n_keys"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change) between two versions: added, removed or changed."""
    joined = before.select("key", F.struct("ptr").alias("old")).join(after.select("key", F.struct("ptr").alias("new")), "key", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return joined.select("key", change.alias("change")).where("change is not null")


def map_of(values: DataFrame, key: Column, data: str, seq: Column) -> DataFrame:
    """A log that sets each row's key to the id of its data."""
    return values.select(seq.alias("seq"), F.lit("set").alias("op"), key.alias("key"), ids.content_id(F.col(data).cast("binary")).alias("ptr"))
