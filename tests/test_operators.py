import base64
import hashlib
import http.server
import json
import os
import random
import re
import threading
import time
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hashloom.functions import ids
from hashloom.operators import arrays, grid, maps, metrics, namespace, objects
from hashloom.plans import trie
from hashloom.sources import gateway, scratch
from hashloom.streaming import log_stream

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LOG = "seq long, op string, key string, ptr string"


def view_of(spark, keys):
    return spark.createDataFrame([(k, f"p{k}") for k in keys], "key string, ptr string")


def depth_of(keys, bucket):
    hashes = {k: hashlib.sha256(k.encode()).hexdigest() for k in keys}
    counts = [Counter(h[: 2 * d] for h in hashes.values()) for d in range(33)]
    return {k: next(d for d in range(32) if counts[d + 1][h[: 2 * d + 2]] <= bucket) for k, h in hashes.items()}


@FEW
@given(st.sets(st.text(st.characters(exclude_categories=["Cs"]), max_size=8), max_size=300), st.integers(1, 6))
def test_layout(spark, keys, bucket):
    got = {r.key: r.depth for r in trie.layout(view_of(spark, keys), bucket).collect()}
    assert got == depth_of(keys, bucket)


def test_bucket_size_never_loses_keys(spark):
    keys = [str(k) for k in range(3000)]
    for bucket in (1, 2, 7, 3000):
        placed = trie.layout(view_of(spark, keys), bucket)
        assert placed.count() == 3000 and placed.groupBy("node", "slot").count().agg(F.max("count")).first()[0] <= bucket
    with pytest.raises(ValueError):
        trie.layout(view_of(spark, keys), 0)


def test_keys_that_share_a_byte(spark):
    first = hashlib.sha256(b"0").hexdigest()[:2]
    keys = [str(k) for k in range(4000) if hashlib.sha256(str(k).encode()).hexdigest()[:2] == first][:3]
    placed = trie.layout(view_of(spark, keys), 1)
    assert {r.depth for r in placed.collect()} == {1}
    assert [(r.node, r.child) for r in trie.links(placed).collect()] == [("", first)]
    assert trie.nodes(placed).exceptAll(trie.deserialize(trie.serialize(trie.nodes(placed)))).isEmpty()
    with pytest.raises(Exception):
        trie.deserialize(spark.createDataFrame([("", "no json")], "node string, body string")).collect()


def test_root_is_a_function_of_the_map(spark):
    root = lambda keys: {r.digest for r in trie.merkle(trie.layout(view_of(spark, keys))).where("node = ''").collect()}
    keys = [f"k{i}" for i in range(900)]
    assert root(keys) == root(keys[::-1]) != root(keys[1:]) and root([]) == set()


@FEW
@given(st.lists(st.tuples(st.sampled_from(["set", "delete"]), st.sampled_from("abcdef"), st.none() | st.sampled_from("xyz")), max_size=30))
def test_log_as_dict(spark, changes):
    want = {}
    for op, key, ptr in changes:
        want.pop(key, None)
        if op == "set":
            want[key] = ptr
    log = spark.createDataFrame([(i, *c) for i, c in enumerate(changes)], LOG)
    view = maps.snapshot(log)
    assert {r.key: r.ptr for r in view.collect()} == want
    assert maps.length(view).first()[0] == len(want)
    assert {r.key for r in maps.missing(view, spark.createDataFrame([(c,) for c in "abcdef"], "key string")).collect()} == set("abcdef") - set(want)


def test_map_changes(spark):
    log = spark.createDataFrame([(1, "set", "foo", "bar")], LOG)
    log = maps.set_all(log, view_of(spark, ["foo", "new"]))
    log = maps.set_all(log, spark.createDataFrame([("foo", "no"), ("late", "yes")], "key string, ptr string"), if_absent=True)
    assert {r.key: r.ptr for r in maps.snapshot(log).collect()} == {"foo": "pfoo", "new": "pnew", "late": "yes"}
    assert {r.key: r.ptr for r in maps.snapshot(log, version=1).collect()} == {"foo": "bar"}
    gone = maps.delete_all(log, spark.createDataFrame([("foo",), ("nothing",)], "key string"))
    assert {r.key for r in maps.snapshot(gone).collect()} == {"new", "late"} and gone.where("key = 'nothing'").isEmpty()
    assert {(r.key, r.change) for r in maps.differences(maps.snapshot(log, version=1), maps.snapshot(gone)).collect()} == {("foo", "removed"), ("new", "added"), ("late", "added")}
    with pytest.raises(Exception, match="no such key: x"):
        maps.require(maps.snapshot(log), spark.createDataFrame([("x",)], "key string")).collect()


def test_objects_on_disk(spark, tmp_path):
    values = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",)], "v string")
    new = objects.put(values, "v")
    assert sorted(bytes(r.data) for r in new.collect()) == [b"", b"a", b"b"]
    objects.save(new, str(tmp_path / "o"))
    stored = spark.read.parquet(str(tmp_path / "o"))
    assert objects.put(values, "v", stored=stored).isEmpty()
    cid = "f01551220" + hashlib.sha256(b"b").hexdigest()
    found = objects.lookup(stored, cid)
    assert bytes(found.first().data) == b"b"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*b0", plan) and "EqualTo(cid" in plan
    missing = objects.load(spark.createDataFrame([("nope",)], "cid string"), stored).first()
    assert missing.data is None


def test_names(spark):
    view = view_of(spark, ["a/b/c/d", "a/b/c/e", "a/b/f", "a/b/g/h/i", "foo/bar/0", "foo/bar/1"])
    names = lambda p: sorted(r.name for r in namespace.list_dir(view, p).collect())
    assert (names("a/b/"), names("foo"), names(""), names("zz/")) == (["c", "f", "g"], ["bar"], ["a", "foo"], [])
    assert namespace.list_prefix(view, "foo/").count() == 2


def test_geometry():
    g = grid.Grid((20, 20), (10, 10), 4)
    assert (g.chunks, g.n_chunks, g.n_shards) == ((2, 2), 4, 1)
    assert [(r.n_chunks, r.n_shards) for r in (g.resized((30, 30)), g.resized((10, 10)), g.resized((20, 0)), g.resized((0, 20)))] == [(9, 3), (1, 1), (0, 0), (0, 0)]
    for bad in (((20,), (0,), 1), ((20,), (-1,), 1), ((-1,), (1,), 1), ((20,), (1,), 0), ((20, 20), (1,), 1)):
        with pytest.raises(ValueError):
            grid.Grid(*bad)
    with pytest.raises(ValueError):
        g.resized((30, 30, 30))


def index_of(spark, rows):
    return spark.createDataFrame([("t", list(c), p) for c, p in rows], "array string, coords array<bigint>, ptr string")


def chunks(df):
    return {tuple(r.coords): r.ptr for r in df.collect()}


def test_keys_of_chunks(spark):
    g = grid.Grid((20, 20), (10, 10), 4)
    keys = ["temp/c/1/0", "zarr.json", "group1/zarr.json", "time/c/0", "lat/c/0/0", "lon/c/0/0", "a/temp/c/0/x", "/c/1/1"]
    got = {r.k: r.p for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", grid.parse_key(F.col("k")).alias("p")).collect()}
    assert got["temp/c/1/0"] == ("temp", [1, 0]) and got["a/temp/c/0/x"] == ("a/temp", [0, None]) and got["/c/1/1"].coords == [1, 1]
    assert all(got[k] is None for k in keys[1:6])
    for bad in ([0, 0, 0, 0], [0, -1], [3, 0], [0, None]):
        with pytest.raises(Exception, match="outside the grid"):
            grid.set_chunks(index_of(spark, []), index_of(spark, [(bad, "p")]), g).collect()


def test_resize_and_graft(spark):
    g = grid.Grid((20, 20), (10, 10), 4)
    index = index_of(spark, [((1, 0), "a"), ((0, 1), "b"), ((1, 1), "c")])
    assert chunks(grid.resize(index, g.resized((30, 30)))) == {(1, 0): "a", (0, 1): "b", (1, 1): "c"}
    assert chunks(grid.resize(index, g.resized((10, 20)))) == {(0, 1): "b"}
    tall = grid.Grid((40, 20), (10, 10), 4)
    source = index_of(spark, [((0, 0), "s"), ((0, 1), None)])
    assert chunks(grid.graft(index, source, (1, 0), tall)) == {(1, 0): "s", (0, 1): "b", (1, 1): "c"}
    with pytest.raises(Exception, match="outside the grid"):
        grid.graft(index, source, (10, 0), tall).collect()
    assert chunks(grid.set_chunks(index, index_of(spark, [((1, 1), None), ((0, 0), "n")]), g)) == {(1, 0): "a", (0, 1): "b", (0, 0): "n"}
    assert chunks(grid.append(index, index, g, g)[0]) == {(1, 0): "a", (0, 1): "b", (1, 1): "c", (3, 0): "a", (2, 1): "b", (3, 1): "c"}


def test_resize_by_metadata(spark):
    g = grid.Grid((20, 20), (10, 10), 4)
    index = index_of(spark, [((1, 0), "a"), ((0, 1), "b"), ((1, 1), "c")])
    got, grown = grid.resize_by_metadata(index, '{"shape": [10, 30], "zarr_format": 3}', g)
    assert grown.array_shape == (10, 30) and chunks(got) == {(0, 1): "b"}
    for bad, what in (("{}", "no shape"), ('{"shape": [3]}', "number of dimensions")):
        with pytest.raises(ValueError, match=what):
            grid.resize_by_metadata(index, bad, g)


def test_other_coordinate_names(spark):
    keys = spark.createDataFrame([("a/depth/c/0",), ("a/time/c/1",), ("v/c/2/3",)], "key string")
    of = lambda *names: {r.key for r in keys.where(grid.parse_key(F.col("key"), *names).isNotNull()).collect()}
    assert of() == {"a/depth/c/0", "v/c/2/3"} and of(("depth",)) == {"a/time/c/1", "v/c/2/3"}


def test_append_of_another_length(spark):
    days, more = grid.Grid((100, 4), (20, 4), 50), grid.Grid((50, 4), (20, 4), 50)
    index = index_of(spark, [((k, 0), f"d{k}") for k in range(5)])
    got, grown = grid.append(index, index_of(spark, [((k, 0), f"m{k}") for k in range(3)]), days, more)
    assert grown.array_shape == (150, 4) and chunks(got) == {(k, 0): f"d{k}" if k < 5 else f"m{k - 5}" for k in range(8)}
    with pytest.raises(ValueError, match="not full"):
        grid.append(index, index, grid.Grid((25, 4), (10, 4), 50), grid.Grid((25, 4), (10, 4), 50))
    with pytest.raises(ValueError, match="does not fit"):
        grid.append(index, index, days, grid.Grid((50, 8), (20, 4), 50))
    with pytest.raises(ValueError, match="cannot be appended"):
        grid.append(index, index, days, grid.Grid((50, 4), (10, 4), 50))


def test_linear_numbers(spark):
    g = grid.Grid((4, 5, 6), (1, 1, 1), 7)
    row = grid.sharded(index_of(spark, [((1, 2, 3), "p")]), g).first()
    assert (row.lin, row.shard, row.slot) == (45, 6, 3)
    with pytest.raises(Exception, match="not a grid"):
        grid.geometry(spark.createDataFrame([([4], [0], 1)], "array_shape array<bigint>, chunk_shape array<bigint>, chunks_per_shard bigint")).collect()


def test_nearest(spark):
    labels, asked = [1.0, 4.0, 4.0, 10.0, 11.0], [-5.0, 1.0, 2.5, 2.6, 7.0, 10.5, 99.0]
    got = {r.target: r.x for r in arrays.nearest(spark.createDataFrame([(v,) for v in labels], "x double"), "x", spark.createDataFrame([(v,) for v in asked], "target double")).collect()}
    assert got == {t: min(labels, key=lambda v: (abs(v - t), v)) for t in asked}


def test_nearest_of_skewed_labels(spark, monkeypatch):
    monkeypatch.setattr(arrays, "RANGE_ROWS", 50)
    r = random.Random(1)
    labels = [r.random() for _ in range(400)] + [1e15, -1e15, 5.0]
    asked = [r.random() * 2 - 0.5 for _ in range(200)] + [1e14, -2e15, 9e14, 3.0]
    frame = lambda rows, kind: spark.createDataFrame([(v,) for v in rows], kind)
    got = {x.target: x.x for x in arrays.nearest(frame(labels, "x double"), "x", frame(asked, "target double")).collect()}
    assert got == {t: min(labels, key=lambda v: (abs(v - t), v)) for t in asked}
    assert {x.x for x in arrays.nearest(frame([], "x double"), "x", frame([1.0], "target double")).collect()} == {None}


def test_selections_reach_the_scan(spark):
    from hashloom import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    pushed = [x for x in plan(queries.arr_sel_box(spark, sf)).splitlines() if "PushedFilters" in x]
    assert pushed and all("GreaterThanOrEqual(ts" in x and "LessThan(ts" in x and "user_id" in x for x in pushed)
    assert re.search(r"PartitionFilters: \[[^\]]*h_chunk", plan(queries.arr_pruned_sel(spark, sf)))


def test_array_steps(spark):
    cells = spark.createDataFrame([(i, float(i)) for i in range(10)], "t long, v double")
    assert arrays.differences(cells, cells).isEmpty() and arrays.not_increasing(cells, "t", "v").isEmpty()
    assert [r.t for r in arrays.append(cells, cells, "t").orderBy("t").collect()] == list(range(20))
    empty = cells.limit(0)
    assert arrays.append(empty, cells, "t").count() == 10 and arrays.stitch(empty, cells, "t").count() == 10
    assert [r.t for r in arrays.not_increasing(cells.withColumn("v", F.when(F.col("t") == 5, 4.0).otherwise(F.col("v"))), "t", "v").collect()] == [5]


def test_metrics(spark):
    loads = spark.createDataFrame([("cid-a", 10), ("cid-a", 20)], "cid string, bytes long")
    assert metrics.repeats(loads, "cid").first() == (2, 1, 1) and metrics.most_common(loads, "cid").first() == ("cid-a", 2)
    values = spark.createDataFrame([("t", 0.1, 1), ("t", 0.2, 2), ("v", 3.0, 1), ("v", 4.0, 2), ("n", None, 1)], "name string, value double, at int")
    got = {r["name"]: r for r in metrics.distribution(values, "name", "value", ("at",), limit=1).collect()}
    assert (got["t"].n_sample, got["v"].n, got["v"].avg, got["n"].n, got["n"].p50) == (1, 2, 3.5, 0, None)
    times = spark.createDataFrame([(0, 10), (5, 7), (10, 12), (6, 8000), (7000, 7001)], "a long, b long").select(F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    assert metrics.max_inflight(times, "a", "b").first()[0] == 3


def test_first_values_over_partitions(spark, monkeypatch):
    """The sample is that of all partitions together, however they are merged."""
    monkeypatch.setattr(metrics, "FAN", 2)
    values = spark.range(1000).select(F.lit("hot").alias("name"), F.col("id").alias("value"), (999 - F.col("id")).alias("at")).repartition(7)
    got = metrics.distribution(values, "name", "value", ("at",), limit=10).first()
    assert (got.n, got.n_sample, got.min, got.max) == (1000, 10, 990, 999)


def test_inflight_over_ranges(spark, monkeypatch):
    """Levels are carried over the ends of ranges; many loads begin and end at one time."""
    whole = scratch.ranged
    monkeypatch.setattr(scratch, "ranged", lambda df, column: whole(df, column, rows=5))
    rows = [(k % 17, k % 17 + 1 + k % 29) for k in range(200)] + [(3, 40)] * 50
    loads = spark.createDataFrame(rows, "a long, b long")
    most = max(sum(a <= t < b for a, b in rows) for t in range(60))
    assert metrics.max_inflight(loads, "a", "b").first()[0] == most


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "set", "k", "a"), (2, "delete", "k", None), (3, "set", "m", "b")], LOG).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    log_stream.commit(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert {r.key: r.ptr for r in maps.snapshot(spark.read.parquet(str(tmp_path / "log"))).collect()} == {"m": "b"}
    q = log_stream.latest(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.op) for r in spark.table("latest").collect()} == {("k", "delete"), ("m", "set")}


@pytest.fixture
def server():
    store, fails, flight = {}, Counter(), Counter(pause=0)

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            cid = self.path.rsplit("/", 1)[1]
            flight["now"] += 1
            flight["most"] = max(flight["most"], flight["now"])
            flight["headers"] = dict(self.headers)
            time.sleep(flight["pause"])
            flight["now"] -= 1
            if cid not in store:
                return self.send_error(404)
            data = store[cid]
            if m := re.match(r"bytes=(\d*)-(\d*)", self.headers.get("Range", "")):
                a, b = m.groups()
                data = data[-int(b) :] if not a else data[int(a) : int(b) + 1 if b else None]
            self.answer(data)

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            data = body.split(b"\r\n\r\n", 1)[1].rsplit(b"\r\n--", 1)[0]
            cid = "f01551220" + hashlib.sha256(data).hexdigest()
            store[cid] = data
            flight["headers"] = dict(self.headers)
            lower = "b" + base64.b32encode(bytes.fromhex(cid[1:])).decode().lower().rstrip("=")
            self.answer(json.dumps({"Hash": flight.get("wrong") or lower}).encode())

        def answer(self, data):
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            fails["seen"] += 1

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", store, flight
    httpd.shutdown()


def test_gateway(spark, server):
    url, store, _ = server
    spark.dataSource.register(gateway.GatewaySource)
    values = objects.put(spark.createDataFrame([("0123456789abcdefghij",), ("b",)], "v string"), "v")
    values.select("cid", "data").write.format("cas_gateway").option("rpc", url).mode("append").save()
    assert sorted(store.values()) == [b"0123456789abcdefghij", b"b"]
    cids = sorted(store)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("cas_gateway").option("gateway", f"{url}/ipfs/").option("ids", ",".join(cids)).load()
    assert {r.cid: bytes(r.data) for r in read.collect()} == store
    assert spark.read.format("cas_gateway").option("gateway", url).load().where(F.col("cid") == cids[0]).count() == 1
    long = max(cids, key=lambda c: len(store[c]))
    asked = spark.createDataFrame([(long, 10, 5, None), (long, None, None, 3), (long, None, None, 0), (long, 4, 0, None)], "cid string, offset int, length int, suffix int")
    assert sorted(bytes(r.data) for r in gateway.load_remote(asked, url).collect()) == [b"", b"", b"abcde", b"hij"]
    with pytest.raises(Exception, match="404"):
        gateway.load_remote(spark.createDataFrame([("nope",)], "cid string"), url).collect()


def test_gateway_filters_and_ids(spark, server):
    url, store, _ = server
    spark.dataSource.register(gateway.GatewaySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    values = objects.put(spark.createDataFrame([("a",), ("b",), ("c",)], "v string"), "v")
    written = gateway.save_remote(values, url).collect()
    assert all(r.cid == r.remote_id for r in written) and set(store) == {r.cid for r in written}
    a, b, c = sorted(store)
    read = spark.read.format("cas_gateway").option("gateway", url)
    both = lambda df: {r.cid for r in df.where(F.col("cid") == b).where(F.col("cid").isin(c, b)).collect()}
    assert both(read.load()) == {b} and both(read.option("ids", a).load()) == set()
    assert read.option("ids", a).load().where(F.col("cid") == b).where(F.col("cid").isin(c)).isEmpty()
    with pytest.raises(Exception, match="name the objects"):
        spark.read.format("cas_gateway").option("gateway", url).load().collect()
    store[a] = b"other"
    with pytest.raises(Exception, match="another hash"):
        gateway.load_remote(spark.createDataFrame([(a,)], "cid string"), url).collect()


def test_gateway_requests(server):
    url, store, flight = server
    cids = []
    for k in range(12):
        cids.append(gateway.add(url, b"%d" % k, headers=gateway.with_authentication({"X-Own": "1"}, "ann", "pw")))
    assert flight["headers"]["X-Own"] == "1" and flight["headers"]["Authorization"] == "Basic " + base64.b64encode(b"ann:pw").decode()
    assert set(cids) == set(store)
    flight["pause"] = 0.05
    assert list(gateway.in_flight(lambda c: gateway.fetch(url, c, headers={"X-Own": "2"}), cids, 3)) == [b"%d" % k for k in range(12)]
    assert 1 < flight["most"] <= 3 and flight["headers"]["X-Own"] == "2"
    flight["wrong"] = cids[0]
    with pytest.raises(ValueError, match="another hash"):
        gateway.add(url, b"x")
    with pytest.raises(ValueError):
        list(gateway.in_flight(len, [b""], 0))


def test_tries(monkeypatch):
    pauses = []
    monkeypatch.setattr(gateway.time, "sleep", pauses.append)

    def broken():
        raise TimeoutError

    with pytest.raises(TimeoutError):
        gateway.tried_again(broken, retries=3)
    assert len(pauses) == 3 and all(abs(p / w - 1) <= 0.051 for p, w in zip(pauses, (1, 2, 4)))
    with pytest.raises(ValueError):
        gateway.tried_again(broken, retries=-1)
    with pytest.raises(ValueError):
        gateway.add("http://x", b"", chunker="size-0")
    assert ids.CODECS["raw"] == "55"


def test_repeated_keys_of_one_call(spark):
    log = spark.createDataFrame([], "seq long, op string, key string, ptr string")
    changes = spark.createDataFrame([("k", p) for p in ("b", "c", None, "a")], "key string, ptr string").repartition(4)
    assert [tuple(r) for r in maps.snapshot(maps.set_all(log, changes)).collect()] == [("k", "c", 1)]
