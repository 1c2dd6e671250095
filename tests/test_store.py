import pytest
from pyspark.sql import functions as F

from hashloom.convert import main
from hashloom.operators import grid, store


def values(spark, **kv):
    return spark.createDataFrame([(k.replace("__", "/"), bytearray(v)) for k, v in kv.items()], "key string, data binary")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_map_store(spark, tmp_path):
    s = store.MapStore(spark, str(tmp_path / "m"))
    assert len(s) == 0 and s.root() is None and s.get(keys(spark, "a")).first().found is False
    assert s.set(values(spark, a=b"1", b=b"2", c=b"1")) == 1
    assert s.objects().count() == 2 and len(s) == 3
    first = s.root()
    s.set(values(spark, a=b"3", d=b"4"))
    s.set(values(spark, a=b"9", e=b"5"), if_absent=True)
    s.delete(keys(spark, "b", "nothing"))
    assert {r.key: bytes(r.data) for r in s.get(s.list()).collect()} == {"a": b"3", "c": b"1", "d": b"4", "e": b"5"}
    old = store.MapStore(spark, str(tmp_path / "m"), version=1)
    assert sorted(r.key for r in old.list().collect()) == ["a", "b", "c"] and old.root() == first
    assert s.versions().orderBy("version").select("n_keys").toPandas().n_keys.tolist() == [3, 4, 5, 4]
    for guarded in (old, s.with_read_only()):
        with pytest.raises(PermissionError):
            guarded.set(values(spark, z=b"1"))
        with pytest.raises(PermissionError):
            guarded.delete(keys(spark, "a"))
    assert s.with_read_only(False) is s and s.with_read_only().with_read_only().read_only
    again = store.MapStore(spark, str(tmp_path / "n"))
    again.set(values(spark, c=b"1", b=b"2"))
    again.set(values(spark, a=b"1"))
    assert again.root() == first and again.same_content(old) and not again.same_content(s)


def test_a_version_that_broke_off_is_not_read(spark, tmp_path):
    s = store.MapStore(spark, str(tmp_path / "m"))
    s.set(values(spark, a=b"1"))
    spark.createDataFrame([(2, "set", "ghost", "p")], "seq long, op string, key string, ptr string").write.parquet(str(tmp_path / "m/log/version=2"))
    assert len(s) == 1
    s.set(values(spark, b=b"2"))
    assert sorted(r.key for r in s.list().collect()) == ["a", "b"]


def rows(spark, *cells):
    return spark.createDataFrame([("t", list(c), p) for c, p in cells], "array string, coords array<bigint>, ptr string")


def test_shard_store(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(ValueError):
        store.ShardStore(spark, path)
    with pytest.raises(PermissionError):
        store.ShardStore(spark, path, grid.Grid((4, 4), (1, 1), 4), read_only=True)
    s = store.ShardStore(spark, path, grid.Grid((4, 4), (1, 1), 4))
    root = s.flush(rows(spark, ((0, 0), "a"), ((1, 1), "b"), ((3, 3), "c")))
    assert s.flush(s.index()) == root and spark.read.parquet(f"{path}/roots").count() == 1
    with pytest.raises(ValueError):
        store.ShardStore(spark, path, grid.Grid((4, 4), (1, 1), 4))
    s = store.ShardStore(spark, path)
    changed = grid.set_chunks(s.index(), rows(spark, ((1, 2), "d"), ((3, 3), None)), s.grid())
    assert s.flush(changed) != root
    written = spark.read.parquet(f"{path}/shards/flush=2").select("shard").collect()
    assert sorted(r.shard for r in written) == [1, 3]
    assert {tuple(r.coords): r.ptr for r in s.index().collect()} == {(0, 0): "a", (1, 1): "b", (1, 2): "d"}
    s.resize((8, 4))
    assert s.grid().chunks == (8, 4) and s.index().count() == 3
    s.resize((1, 4))
    assert {tuple(r.coords): r.ptr for r in s.index().collect()} == {(0, 0): "a"}
    other = store.ShardStore(spark, str(tmp_path / "o"), grid.Grid((4, 4), (1, 1), 4))
    other.flush(rows(spark, ((2, 2), "z")))
    other.graft(s, (1, 1))
    assert {tuple(r.coords): r.ptr for r in other.index().collect()} == {(1, 1): "a", (2, 2): "z"}
    with pytest.raises(PermissionError):
        store.ShardStore(spark, path, read_only=True).resize((4, 4))


def test_conversion(spark, tmp_path, capsys):
    m = store.MapStore(spark, str(tmp_path / "m"))
    m.set(values(spark, t__c__0__0=b"1", t__c__1__1=b"2", **{"t__zarr.json": b"{}"}))
    args = [str(tmp_path / "m"), str(tmp_path / "s"), "--shape", "20,20", "--chunks", "10,10"]
    assert main(args, spark) == 0
    s = store.ShardStore(spark, str(tmp_path / "s"))
    assert capsys.readouterr().out.strip() == s.root()
    back = grid.as_map(s.index(), m.view().where("key like '%json'"))
    assert back.exceptAll(m.view().select("key", "ptr")).isEmpty() and back.count() == 3
    assert main(args, spark) == 1 and "already" in capsys.readouterr().err
    assert s.index().where(F.col("array") != "t").isEmpty()
