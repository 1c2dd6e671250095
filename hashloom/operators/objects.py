"""Content-addressed objects: tables of (cid, codec, data, n_bytes, b0), one row for each content.

``b0`` is the first byte of the content hash, the partition column when objects
are written, so that a lookup by id reads one partition in 256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hashloom.functions import ids, ranges

#: The forms of a chunker option (fixed by the public interface).
CHUNKER = r"size-[1-9]\d*|rabin|rabin-[1-9]\d*-[1-9]\d*-[1-9]\d*"


def addressed(values: DataFrame, data: str, codec: str = "raw") -> DataFrame:
    """The rows with the id of their data; rows without data have none."""
    return values.withColumn("cid", ids.content_id(F.col(data).cast("binary"), codec))


def put(values: DataFrame, data: str, codec: str = "raw", stored: DataFrame | None = None) -> DataFrame:
    """The objects to append for these rows: each content once, without those already stored.

    Ids alone are compared with those stored (no content is moved for that), and
    only rows with a new id go on. One row of each id is then kept by an aggregate
    with map-side combine, so a content that a third of the rows share meets as
    one row a task.
    """
    own = addressed(values, data, codec).where("cid is not null").select("cid", F.col(data).cast("binary").alias("data"))
    if stored is not None:
        new = own.select("cid").distinct().join(stored.select("cid"), "cid", "left_anti")
        own = own.join(new, "cid", "left_semi")
    own = own.groupBy("cid").agg(F.first("data").alias("data"))
    return own.select("cid", F.lit(codec).alias("codec"), "data", F.octet_length("data").cast("long").alias("n_bytes"), first_byte(F.col("cid")).alias("b0"))


def first_byte(cid: Column) -> Column:
    return ids.slot(F.substring(cid, len(ids.CID_PREFIX) + 7, 64), 0)


def save(objects: DataFrame, path: str) -> None:
    """Append objects to a table folder, partitioned by the first hash byte."""
    objects.write.mode("append").partitionBy("b0").parquet(path)


def load(requests: DataFrame, objects: DataFrame, offset: str | None = None, length: str | None = None, suffix: str | None = None) -> DataFrame:
    """The requested ids (column cid, other columns stay) with their data or a part of it; null where there is no such object."""
    part = lambda c: None if c is None else F.col(c)
    joined = requests.join(objects.select("cid", "data"), "cid", "left")
    return joined.withColumn("data", ranges.read_range(F.col("data"), part(offset), part(length), part(suffix)))


def lookup(objects: DataFrame, cid: str) -> DataFrame:
    """One object; the predicate on b0 prunes partitions."""
    first = int(cid[len(ids.CID_PREFIX) + 6 :][:2], 16)
    return objects.where((F.col("b0") == first) & (F.col("cid") == cid))


def duplicates(values: DataFrame, data: str, key: str) -> DataFrame:
    """Contents that several rows share: cid, copies, first key."""
    return addressed(values, data).where("cid is not null").groupBy("cid").agg(F.count("*").alias("copies"), F.min(key).alias("first_key")).where("copies > 1")


def bytes_saved(values: DataFrame, data: str) -> DataFrame:
    """Rows, contents, and bytes with and without sharing."""
    sized = addressed(values, data).where("cid is not null").select("cid", F.octet_length(F.col(data).cast("binary")).cast("long").alias("n"))
    by_id = sized.groupBy("cid").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    return by_id.agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_objects"), F.sum(F.col("rows") * F.col("n")).alias("bytes_put"), F.sum("n").alias("bytes_stored"), F.sum((F.col("rows") - 1) * F.col("n")).alias("bytes_saved"))


def pin(pins: DataFrame, cids: DataFrame) -> DataFrame:
    """Pins with further ids (each once)."""
    return pins.select("cid").unionByName(cids.select("cid")).distinct()


def unpin(pins: DataFrame, cids: DataFrame) -> DataFrame:
    """Pins without these ids; ids that are not pinned do not matter."""
    return pins.select("cid").join(cids.select("cid"), "cid", "left_anti")


def pin_update(pins: DataFrame, changes: DataFrame) -> DataFrame:
    """Pins after changes (old, new): an old id's pin moves to the new id."""
    moved = pins.select("cid").join(changes.select(F.col("old").alias("cid"), "new"), "cid", "left")
    return moved.select(F.coalesce("new", "cid").alias("cid")).distinct()


def collect_garbage(objects: DataFrame, pins: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """The objects that stay: pinned ones, and those that maps refer to (column ptr)."""
    held = pins.select("cid") if references is None else pins.select("cid").unionByName(references.select(F.col("ptr").alias("cid")))
    return objects.join(held, "cid", "left_semi")


def valid_chunker(option: Column) -> Column:
    """Whether a chunker option has one of the known forms."""
    return option.rlike(f"^({CHUNKER})$")
