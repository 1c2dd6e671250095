"""Stores in a folder: a versioned map with its objects, and a sharded chunk index.

Both are append-only: a commit writes a folder of its own (``version=N`` or
``flush=N``) and then one row that makes it count, so a commit that breaks off
leaves nothing that is read, and readers of an older version are not disturbed.
One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from hashloom.operators import grid, maps, namespace, objects
from hashloom.plans import trie

LOG = "seq long, op string, key string, ptr string, version long"
VERSIONS = "version long, root string, n_keys long"
OBJECTS = "cid string, codec string, data binary, n_bytes long, b0 int"
CHUNKS = "array string, coords array<bigint>, ptr string, shard long, flush long"
SHARDS = "array string, shard long, digest string, flush long"
ROOTS = "flush long, array_shape array<bigint>, chunk_shape array<bigint>, chunks_per_shard long, root string"
#: Of several values for one key in one version, the one with the greatest pointer counts.
_ORDER = ("seq", "op", "ptr")

#: Shards hashed together, and levels of such groups before an array's own digest.
_FAN, _SHARD_LEVELS = 1024, 2


class _Folder:
    def __init__(self, spark: SparkSession, path: str, read_only: bool):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _guard(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")


class MapStore(_Folder):
    """A map from keys to byte values: log, objects and versions below one folder."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, version: int | None = None):
        """``version``: read as of that version; such a store is read-only."""
        super().__init__(spark, path, read_only or version is not None)
        self.version = version

    def with_read_only(self, read_only: bool = True) -> MapStore:
        return self if read_only == self.read_only else MapStore(self.spark, self.path, read_only)

    def log(self) -> DataFrame:
        log = self._table("log", LOG).join(self.versions().select("version"), "version", "left_semi")
        return log if self.version is None else log.where(F.col("version") <= self.version)

    def versions(self) -> DataFrame:
        return self._table("versions", VERSIONS)

    def objects(self) -> DataFrame:
        return self._table("objects", OBJECTS)

    def view(self) -> DataFrame:
        return maps.snapshot(self.log(), order=_ORDER)

    def root(self) -> str | None:
        """The digest that identifies the map's content; None for an empty map."""
        rows = self.versions() if self.version is None else self.versions().where(F.col("version") <= self.version)
        last = rows.agg(F.max_by("root", "version").alias("root")).first()
        return last.root

    def same_content(self, other: MapStore) -> bool:
        return self.root() == other.root()

    def set(self, values: DataFrame, if_absent: bool = False) -> int:
        """Set (key, data) rows as one version. Contents that are stored already are not written again."""
        self._guard()
        if if_absent:
            values = values.join(self.view().select("key"), "key", "left_anti")
        objects.save(objects.put(values, "data", stored=self.objects()), f"{self.path}/objects")
        return self._commit(objects.addressed(values, "data").select(F.lit("set").alias("op"), "key", F.col("cid").alias("ptr")))

    def delete(self, keys: DataFrame) -> int:
        """Delete keys as one version; keys that are not there do not matter."""
        self._guard()
        there = keys.select("key").distinct().join(self.view().select("key"), "key", "left_semi")
        return self._commit(there.select(F.lit("delete").alias("op"), "key", F.lit(None).cast("string").alias("ptr")))

    def _commit(self, changes: DataFrame) -> int:
        version = (self.versions().agg(F.max("version")).first()[0] or 0) + 1
        target = f"{self.path}/log/version={version}"
        changes.select(F.lit(version).cast("long").alias("seq"), "op", "key", "ptr").write.mode("overwrite").parquet(target)
        own = self.spark.read.schema("seq long, op string, key string, ptr string").parquet(target)
        view = maps.snapshot(self.log().select("seq", "op", "key", "ptr").unionByName(own), order=_ORDER)
        root = trie.merkle(trie.layout(view)).where("node = ''").select("digest").first()
        row = [(version, root.digest if root else None, view.count())]
        self.spark.createDataFrame(row, VERSIONS).write.mode("append").parquet(f"{self.path}/versions")
        return version

    def get(self, keys: DataFrame) -> DataFrame:
        return maps.get(self.view(), self.objects(), keys)

    def exists(self, keys: DataFrame) -> DataFrame:
        return maps.exists(self.view(), keys)

    def list(self, prefix: str = "") -> DataFrame:
        return namespace.list_prefix(self.view(), prefix)

    def list_dir(self, prefix: str = "") -> DataFrame:
        return namespace.list_dir(self.view(), prefix)

    def __len__(self) -> int:
        return self.view().count()


def _root(shards: DataFrame, shape: str) -> str:
    """The digest of all shards of all arrays: hashes of bounded groups of shards, then of arrays, so that no row holds them all."""
    joined = lambda: F.sha2(F.array_join(F.sort_array(F.collect_list("entry")), "|"), 256)
    rows = shards.select("array", "shard", F.concat_ws(":", F.lpad(F.col("shard").cast("string"), 20, "0"), "digest").alias("entry"))
    for _ in range(_SHARD_LEVELS):
        rows = rows.withColumn("shard", F.floor(F.col("shard") / _FAN)).groupBy("array", "shard").agg(joined().alias("entry"))
        rows = rows.select("array", "shard", F.concat_ws(":", F.lpad(F.col("shard").cast("string"), 20, "0"), "entry").alias("entry"))
    rows = rows.groupBy("array").agg(joined().alias("entry")).select(F.sha2(F.concat("array", "entry"), 256).alias("entry"))
    for digits in (6, 3):
        rows = rows.groupBy(F.substr("entry", F.lit(1), F.lit(digits)).alias("part")).agg(joined().alias("entry"))
        rows = rows.select(F.concat("part", "entry").alias("entry"))
    return rows.select(joined().alias("entry")).select(F.sha2(F.concat(F.lit(shape), "entry"), 256)).first()[0]


class ShardStore(_Folder):
    """A chunk index in shards: a flush writes the shards that changed, and the manifest says which flush holds each."""

    def __init__(self, spark: SparkSession, path: str, new: grid.Grid | None = None, read_only: bool = False):
        """Open a store, or make one with a grid. Errors: nothing there to open, or something there already."""
        super().__init__(spark, path, read_only)
        last = self._last()
        if last is None and new is None:
            raise ValueError(f"no chunk index in {path}")
        if last is None:
            self._guard()
        elif new is not None:
            raise ValueError(f"there is a chunk index in {path} already")
        self._new = new

    def _last(self):
        return self._table("roots", ROOTS).orderBy(F.desc("flush")).first()

    def grid(self) -> grid.Grid:
        last = self._last()
        return self._new if last is None else grid.Grid(tuple(last.array_shape), tuple(last.chunk_shape), last.chunks_per_shard)

    def root(self) -> str | None:
        last = self._last()
        return last.root if last else None

    def manifest(self) -> DataFrame:
        """(array, shard, digest, flush) of the shards with chunks."""
        counted = self._table("shards", SHARDS).join(self._table("roots", ROOTS).select("flush"), "flush", "left_semi")
        latest = counted.groupBy("array", "shard").agg(F.max_by(F.struct("digest", "flush"), "flush").alias("m"))
        return latest.select("array", "shard", "m.digest", "m.flush").where("digest is not null")

    def index(self) -> DataFrame:
        rows = self._table("chunks", CHUNKS)
        return rows.join(self.manifest().select("array", "shard", "flush"), ["array", "shard", "flush"], "left_semi").select("array", "coords", "ptr")

    def flush(self, index: DataFrame, own: grid.Grid | None = None) -> str:
        """Make an index (and grid) the current one; the root. Nothing is written if nothing changed."""
        self._guard()
        last, own = self._last(), own or self.grid()
        before = self.manifest().select("array", "shard", F.col("digest").alias("old"))
        both = grid.shard_digests(index, own).select("array", "shard", "digest").join(before, ["array", "shard"], "full")
        flush = (last.flush if last else 0) + 1
        changed = both.where(~F.col("digest").eqNullSafe(F.col("old"))).select("array", "shard", "digest")
        same_grid = last and (tuple(last.array_shape), tuple(last.chunk_shape), last.chunks_per_shard) == (own.array_shape, own.chunk_shape, own.chunks_per_shard)
        if same_grid and changed.isEmpty():
            return last.root
        rows = grid.sharded(index, own).join(changed.select("array", "shard"), ["array", "shard"], "left_semi")
        rows.select("array", "coords", "ptr", "shard").write.mode("overwrite").parquet(f"{self.path}/chunks/flush={flush}")
        changed.write.mode("overwrite").parquet(f"{self.path}/shards/flush={flush}")
        shape = f"{own.array_shape}{own.chunk_shape}{own.chunks_per_shard}"
        root = _root(both.where("digest is not null"), shape)
        row = [(flush, list(own.array_shape), list(own.chunk_shape), own.chunks_per_shard, root)]
        self.spark.createDataFrame(row, ROOTS).write.mode("append").parquet(f"{self.path}/roots")
        return root

    def resize(self, array_shape: tuple[int, ...]) -> str:
        own = self.grid().resized(array_shape)
        return self.flush(grid.resize(self.index(), own), own)

    def graft(self, source: ShardStore, offset: tuple[int, ...]) -> str:
        return self.flush(grid.graft(self.index(), source.index(), offset, self.grid()))


def convert(source: MapStore, target: ShardStore) -> tuple[str, DataFrame]:
    """Move a map's chunk keys to a chunk index, pointers only; its root, and the map's other keys."""
    index, metadata = grid.convert(source.view())
    return target.flush(grid.set_chunks(target.index(), index, target.grid())), metadata
