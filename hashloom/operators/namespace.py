"""Listing keys as paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def list_keys(view: DataFrame, metadata_only: bool = False) -> DataFrame:
    """All keys, or those of metadata documents."""
    keys = view.select("key")
    return keys.where(F.col("key").endswith("zarr.json")) if metadata_only else keys


def list_prefix(view: DataFrame, prefix: str) -> DataFrame:
    """Keys that start with the prefix; the predicate reaches the scan."""
    return view.select("key").where(F.col("key").startswith(prefix))


def next_part(key: Column, prefix: str) -> Column:
    return F.substring_index(F.substr(key, F.lit(len(prefix) + 1)), "/", 1)


def list_dir(view: DataFrame, prefix: str) -> DataFrame:
    """The distinct names directly below a prefix, which ends in '/' or is empty."""
    if prefix and not prefix.endswith("/"):
        prefix += "/"
    return list_prefix(view, prefix).select(next_part(F.col("key"), prefix).alias("name")).where("name <> ''").distinct()
