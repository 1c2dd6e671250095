"""Chunk grids: geometry, chunk keys, sharded chunk indexes and what changes them.

An index is a sparse table (array, coords, ptr): an empty slot has no row. Chunks
are kept by their coordinates, and their linear number, shard and slot follow
from the grid, so no change of the grid can move a chunk to another place.
"""

from __future__ import annotations

import json
from math import prod

from pyspark.sql import Column, DataFrame, functions as F

#: Arrays with these names are coordinates, unless others are named: stored whole, never looked up in the chunk index (fixed values).
COORDINATES = ("time", "lat", "lon", "latitude", "longitude", "forecast_reference_time", "step")


class Grid:
    """Shapes of an array and its chunks, and how many chunks a shard has. Errors for sizes that make no grid."""

    def __init__(self, array_shape: tuple[int, ...], chunk_shape: tuple[int, ...], chunks_per_shard: int):
        if len(array_shape) != len(chunk_shape):
            raise ValueError("array and chunks have different numbers of dimensions")
        if any(c <= 0 for c in chunk_shape) or any(a < 0 for a in array_shape) or chunks_per_shard <= 0:
            raise ValueError("chunk sizes and chunks per shard are positive, array sizes are not negative")
        self.array_shape, self.chunk_shape, self.chunks_per_shard = tuple(array_shape), tuple(chunk_shape), chunks_per_shard
        self.chunks = tuple(-(-a // c) for a, c in zip(array_shape, chunk_shape))
        self.n_chunks = prod(self.chunks)
        self.n_shards = -(-self.n_chunks // chunks_per_shard)

    def resized(self, array_shape: tuple[int, ...]) -> Grid:
        if len(array_shape) != len(self.array_shape):
            raise ValueError("the number of dimensions cannot change")
        return Grid(array_shape, self.chunk_shape, self.chunks_per_shard)

    def linear(self, coords: Column) -> Column:
        """Row-major number of a chunk."""
        out = F.lit(0).cast("long")
        for k, n in enumerate(self.chunks):
            out = out * n + coords[k]
        return out

    def inside(self, coords: Column) -> Column:
        ok = F.size(coords) == len(self.chunks)
        for k, n in enumerate(self.chunks):
            ok = ok & (coords[k] >= 0) & (coords[k] < n)
        return F.coalesce(ok, F.lit(False))

    def shard(self, coords: Column) -> Column:
        return F.floor(self.linear(coords) / self.chunks_per_shard).cast("long")

    def slot(self, coords: Column) -> Column:
        return self.linear(coords) % self.chunks_per_shard

    def checked(self, coords: Column) -> Column:
        """The coordinates, or an error that names those outside the grid."""
        return F.when(self.inside(coords), coords).otherwise(F.raise_error(F.concat(F.lit("chunk outside the grid: "), coords.cast("string"))).cast("array<bigint>"))


def geometry(shapes: DataFrame) -> DataFrame:
    """Adds chunks (array), n_chunks and n_shards to rows with array_shape, chunk_shape and chunks_per_shard."""
    chunks = F.zip_with("array_shape", "chunk_shape", lambda a, c: F.ceil(a / c))
    bad = F.exists("chunk_shape", lambda c: c <= 0) | F.exists("array_shape", lambda a: a < 0) | (F.col("chunks_per_shard") <= 0)
    checked = F.when(bad, F.raise_error(F.lit("not a grid")).cast("array<bigint>")).otherwise(chunks)
    sized = shapes.withColumn("chunks", checked).withColumn("n_chunks", F.aggregate("chunks", F.lit(1).cast("long"), lambda acc, n: acc * n))
    return sized.withColumn("n_shards", F.ceil(F.col("n_chunks") / F.col("chunks_per_shard")))


def parse_key(key: Column, coordinates: tuple[str, ...] = COORDINATES) -> Column:
    """struct(array, coords) of a chunk key, null for a metadata key.

    Metadata keys end in .json, have no '/c/', or belong to an array that is named
    in ``coordinates``. Coordinates that are not numbers are null.
    """
    where = F.length(key) - F.length(F.substring_index(key, "/c/", -1)) - 2
    array = F.substr(key, F.lit(1), where - 1)
    name = F.substring_index(array, "/", -1)
    chunk = ~key.endswith(".json") & key.contains("/c/") & ~name.isin(*coordinates)
    coords = F.transform(F.split(F.substring_index(key, "/c/", -1), "/"), lambda c: c.try_cast("bigint"))
    return F.when(chunk, F.struct(array.alias("array"), coords.alias("coords")))


def chunk_key(array: Column, coords: Column) -> Column:
    return F.concat(array, F.lit("/c/"), F.array_join(F.transform(coords, lambda c: c.cast("string")), "/"))


def set_chunks(index: DataFrame, changes: DataFrame, grid: Grid) -> DataFrame:
    """The index with (array, coords, ptr) rows set; a null pointer empties the slot; an error outside the grid."""
    new = changes.select("array", grid.checked(F.col("coords")).alias("coords"), F.struct("ptr").alias("new"))
    joined = index.select("array", "coords", F.col("ptr").alias("old")).join(new, ["array", "coords"], "full")
    return joined.select("array", "coords", F.when(F.col("new").isNotNull(), F.col("new.ptr")).otherwise(F.col("old")).alias("ptr")).where("ptr is not null")


def resize(index: DataFrame, grid: Grid) -> DataFrame:
    """The chunks of an index that lie inside a new grid, at their places."""
    return index.where(grid.inside(F.col("coords")))


def resize_by_metadata(index: DataFrame, metadata: str, grid: Grid) -> tuple[DataFrame, Grid]:
    """The index and the grid in the shape that an array's new metadata JSON gives; an error if it has none, or one with another number of dimensions."""
    shape = json.loads(metadata).get("shape")
    if not isinstance(shape, list) or not all(isinstance(n, int) for n in shape):
        raise ValueError("the metadata has no shape")
    grown = grid.resized(tuple(shape))
    return resize(index, grown), grown


def graft(target: DataFrame, source: DataFrame, offset: tuple[int, ...], grid: Grid) -> DataFrame:
    """The target's index with the source's chunks at shifted places; where both have one, the source's; an error outside the grid. Pointers only: no content is read or copied."""
    shifted = F.zip_with("coords", F.array(*map(F.lit, offset)).cast("array<bigint>"), lambda a, b: a + b)
    moved = source.where("ptr is not null").select("array", grid.checked(shifted).alias("coords"), F.col("ptr").alias("new"))
    joined = target.select("array", "coords", F.col("ptr").alias("old")).join(moved, ["array", "coords"], "full")
    return joined.select("array", "coords", F.coalesce("new", "old").alias("ptr"))


def append(index: DataFrame, more: DataFrame, grid: Grid, source: Grid, dim: int = 0) -> tuple[DataFrame, Grid]:
    """The index with the source's chunks behind the present ones along one dimension, and the grown grid.

    Pointers can only be moved by whole chunks: an array whose last chunk along
    the dimension is not full is an error (its cells must be chunked anew), and so
    are other chunk shapes or other sizes of the other dimensions. The source's
    own last chunk may be ragged.
    """
    if grid.chunk_shape != source.chunk_shape:
        raise ValueError(f"chunks of {source.chunk_shape} cannot be appended to chunks of {grid.chunk_shape}")
    if any(a != b for k, (a, b) in enumerate(zip(grid.array_shape, source.array_shape)) if k != dim):
        raise ValueError(f"{source.array_shape} does not fit behind {grid.array_shape} along dimension {dim}")
    if grid.array_shape[dim] % grid.chunk_shape[dim]:
        raise ValueError(f"the last chunk along dimension {dim} is not full: {grid.array_shape[dim]} in chunks of {grid.chunk_shape[dim]}")
    offset = tuple(n if k == dim else 0 for k, n in enumerate(grid.chunks))
    grown = grid.resized(tuple(a + b * (k == dim) for k, (a, b) in enumerate(zip(grid.array_shape, source.array_shape))))
    return graft(index, more, offset, grown), grown


def convert(view: DataFrame, coordinates: tuple[str, ...] = COORDINATES) -> tuple[DataFrame, DataFrame]:
    """Index and metadata (key, ptr) of a map whose keys are chunk and metadata keys; pointers only."""
    parsed = view.select("key", "ptr", parse_key(F.col("key"), coordinates).alias("chunk"))
    return parsed.where("chunk is not null").select("chunk.array", "chunk.coords", "ptr"), parsed.where("chunk is null").select("key", "ptr")


def as_map(index: DataFrame, metadata: DataFrame) -> DataFrame:
    """(key, ptr) rows of an index and its metadata: ``convert`` back."""
    return index.select(chunk_key(F.col("array"), F.col("coords")).alias("key"), "ptr").unionByName(metadata.select("key", "ptr"))


def get_chunks(requests: DataFrame, index: DataFrame, objects: DataFrame, grid: Grid) -> DataFrame:
    """(array, coords, data) of the requested chunks: null for an empty slot, an error outside the grid."""
    asked = requests.select("array", grid.checked(F.col("coords")).alias("coords"))
    return asked.join(index, ["array", "coords"], "left").join(objects.select(F.col("cid").alias("ptr"), "data"), "ptr", "left").select("array", "coords", "data")


def sharded(index: DataFrame, grid: Grid) -> DataFrame:
    """The index with lin, shard and slot of each chunk."""
    return index.select("*", grid.linear(F.col("coords")).alias("lin"), grid.shard(F.col("coords")).alias("shard"), grid.slot(F.col("coords")).alias("slot"))


def shard_digests(index: DataFrame, grid: Grid) -> DataFrame:
    """(array, shard, n_chunks, digest): SHA-256 of the shard's slots and pointers in order; a shard has at most chunks_per_shard of them."""
    entry = F.struct("slot", "ptr")
    rows = sharded(index, grid).groupBy("array", "shard").agg(F.count("*").alias("n_chunks"), F.sort_array(F.collect_list(entry)).alias("slots"))
    text = F.array_join(F.transform("slots", lambda s: F.concat(s["slot"].cast("string"), F.lit("="), s["ptr"])), "|")
    return rows.select("array", "shard", "n_chunks", F.sha2(text, 256).alias("digest"))


def changed_shards(before: DataFrame, after: DataFrame, grid: Grid) -> DataFrame:
    """(array, shard) of the shards that a flush has to write."""
    old, new = (shard_digests(x, grid).select("array", "shard", F.col("digest").alias(n)) for x, n in ((before, "old"), (after, "new")))
    return old.join(new, ["array", "shard"], "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("array", "shard")


def set_shape(metadata: Column, shape: tuple[int, ...]) -> Column:
    """An array's metadata JSON with a new shape."""
    kind = "map<string, variant>"
    fields = F.from_json(metadata, kind)
    others = F.map_filter(fields, lambda k, _: k != "shape")
    return F.to_json(F.map_concat(others, F.create_map(F.lit("shape"), F.parse_json(F.lit(str(list(shape)))))))


def shape_of(metadata: Column) -> Column:
    return F.from_json(F.get_json_object(metadata, "$.shape"), "array<bigint>")
