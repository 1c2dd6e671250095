"""Registered queries over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hashloom.functions import crypt, ids, ranges
from hashloom.operators import arrays, grid, maps, metrics, namespace, objects
from hashloom.plans import trie
from hashloom.sources import scratch
from hashloom.streaming import log_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ORIGIN = "2024-01-01 00:00:00"
CHUNK, PER_SHARD = (24, 10), 16


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- objects -----------------------------------------------------------------

_CID = "'f01551220' || sha256({})"
_TEXT_CID = _CID.format("text")


def _documents(spark, d):
    return table(spark, d, "documents")


def _objects(spark, d):
    return objects.put(_documents(spark, d), "text")


@query(f"SELECT DISTINCT {_TEXT_CID} AS cid, 'raw' AS codec, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, CAST('0x' || substr(sha256(text), 1, 2) AS INT) AS b0 FROM documents WHERE text IS NOT NULL")
def cas_put_dedup(spark, d):
    return _objects(spark, d).drop("data")


@query(f"SELECT DISTINCT {_TEXT_CID} AS cid FROM documents WHERE text IS NOT NULL AND {_TEXT_CID} NOT IN (SELECT {_TEXT_CID} FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def cas_put_new_only(spark, d):
    docs = _documents(spark, d)
    return objects.put(docs, "text", stored=objects.put(docs.where("lang = 'en'"), "text")).select("cid")


@query(f"SELECT {_TEXT_CID} AS cid, count(*) AS copies, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def cas_dup_groups(spark, d):
    return objects.duplicates(_documents(spark, d), "text", "doc_id")


@query("""
WITH t AS (SELECT text, count(*) AS k, max(octet_length(encode(text))) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS n_objects, CAST(sum(k * n) AS BIGINT) AS bytes_put, CAST(sum(n) AS BIGINT) AS bytes_stored, CAST(sum((k - 1) * n) AS BIGINT) AS bytes_saved FROM t
""")
def cas_bytes_saved(spark, d):
    return objects.bytes_saved(_documents(spark, d), "text")


def _requests(spark, d):
    return objects.addressed(_documents(spark, d), "text").select("doc_id", "cid")


@query("SELECT doc_id, hex(encode(text)[11:50]) AS part FROM documents")
def cas_range_read(spark, d):
    asked = _requests(spark, d).select("*", F.lit(10).alias("offset"), F.lit(40).alias("length"))
    return objects.load(asked, _objects(spark, d), "offset", "length").select("doc_id", F.hex("data").alias("part"))


@query("SELECT doc_id, hex(encode(text)[31:]) AS part FROM documents")
def cas_offset_read(spark, d):
    return objects.load(_requests(spark, d).withColumn("offset", F.lit(30)), _objects(spark, d), "offset").select("doc_id", F.hex("data").alias("part"))


@query("SELECT doc_id, right(hex(encode(text)), 2 * CAST(doc_id % 25 AS INT)) AS part FROM documents")
def cas_suffix_read(spark, d):
    asked = _requests(spark, d).withColumn("suffix", (F.col("doc_id") % 25).cast("int"))
    return objects.load(asked, _objects(spark, d), suffix="suffix").select("doc_id", F.hex("data").alias("part"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN hex(encode(text)[11:30]) WHEN 1 THEN hex(encode(text)[6:]) WHEN 2 THEN right(hex(encode(text)), 14) ELSE hex(encode(text)) END AS part FROM documents
""")
def cas_byte_requests(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["range", "offset", "suffix"])), F.when(F.col("doc_id") % 4 < 3, (F.col("doc_id") % 4 + 1).cast("int")))
    a = F.when(kind == "range", 10).when(kind == "offset", 5).otherwise(7)
    request = F.when(F.col("doc_id") % 4 < 3, F.struct(kind.alias("kind"), a.alias("a"), F.lit(30).alias("b")))
    return _documents(spark, d).select("doc_id", F.hex(ranges.byte_request(F.col("text"), request)).alias("part"))


@query(f"""
WITH r AS (SELECT doc_id, p AS pos, CASE p WHEN 0 THEN doc_id WHEN 1 THEN doc_id + 1 ELSE -1 END AS want FROM documents, (VALUES (0), (1), (2)) AS t(p))
SELECT r.doc_id, r.pos, left(hex(encode(x.text)), 16) AS part FROM r LEFT JOIN documents x ON x.doc_id = r.want
""")
def cas_partial_values(spark, d):
    """Several requests at once, in their order; null for a key that is not there."""
    docs = _documents(spark, d)
    view = docs.select(F.col("doc_id").cast("string").alias("key"), ids.content_id(F.col("text")).alias("ptr"))
    wanted = F.array(F.col("doc_id"), F.col("doc_id") + 1, F.lit(-1).cast("long"))
    asked = docs.select("doc_id", F.posexplode(wanted).alias("pos", "want")).withColumn("key", F.col("want").cast("string"))
    pointed = asked.join(view, "key", "left").withColumnRenamed("ptr", "cid").withColumns({"offset": F.lit(0), "length": F.lit(8)})
    return objects.load(pointed, _objects(spark, d), "offset", "length").select("doc_id", "pos", F.hex("data").alias("part"))


@query(f"SELECT DISTINCT {_TEXT_CID} AS cid FROM documents WHERE (doc_id % 3 = 0 AND doc_id % 5 <> 0) OR lang = 'fr'")
def pin_gc(spark, d):
    docs = objects.addressed(_documents(spark, d), "text")
    pins = objects.unpin(objects.pin(docs.where("doc_id % 3 = 0 and doc_id % 5 <> 0").select("cid"), docs.where("doc_id < 0")), docs.where("doc_id < 0"))
    return objects.collect_garbage(_objects(spark, d), pins, docs.where("lang = 'fr'").select(F.col("cid").alias("ptr"))).select("cid")


@query("SELECT DISTINCT CASE WHEN n_regionkey = 1 THEN 'new' || n_nationkey ELSE 'old' || n_nationkey END AS cid FROM nation WHERE n_regionkey <> 2")
def pin_update(spark, d):
    nations = table(spark, d, "nation")
    name = lambda p: F.concat(F.lit(p), F.col("n_nationkey").cast("string"))
    pins = nations.select(name("old").alias("cid"))
    moved = objects.pin_update(pins, nations.where("n_regionkey = 1").select(name("old").alias("old"), name("new").alias("new")))
    return objects.unpin(moved, nations.where("n_regionkey = 2").select(name("old").alias("cid")))


@query("""
SELECT n_nationkey, regexp_full_match(o, 'size-[1-9][0-9]*|rabin|rabin-[1-9][0-9]*-[1-9][0-9]*-[1-9][0-9]*') AS valid
FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'size-' || n_nationkey WHEN 1 THEN 'rabin' WHEN 2 THEN 'rabin-' || n_nationkey || '-9-70' ELSE 'rabin-' || n_nationkey END AS o FROM nation)
""")
def cas_chunker_option(spark, d):
    n = F.col("n_nationkey").cast("string")
    option = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("size-"), n)).when(F.col("n_nationkey") % 4 == 1, "rabin").when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("rabin-"), n, F.lit("-9-70"))).otherwise(F.concat(F.lit("rabin-"), n))
    return table(spark, d, "nation").select("n_nationkey", objects.valid_chunker(option).alias("valid"))


# --- maps ----------------------------------------------------------------------

_LOG = "log AS (SELECT event_id AS seq, ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, 'user/' || user_id AS key, 'f01551220' || sha256(props) AS ptr FROM events)"
_LAST = "last AS (SELECT key, arg_max(op, row(ts, seq)) AS op, arg_max(ptr, row(ts, seq)) AS ptr, arg_max(seq, row(ts, seq)) AS seq FROM log GROUP BY key)"
_VIEW = f"WITH {_LOG}, {_LAST}, view AS (SELECT key, ptr, seq FROM last WHERE op = 'set')"
_ORDER = ("ts", "seq")


def _log(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), ids.content_id(F.col("props")).alias("ptr"),
    )


def _view(spark, d):
    return maps.snapshot(_log(spark, d), order=_ORDER)


@query(f"{_VIEW} SELECT key, ptr, seq FROM view")
def kv_latest(spark, d):
    return _view(spark, d)


@query(f"WITH {_LOG} SELECT key, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS r FROM log) WHERE r = 1")
def kv_last_write(spark, d):
    last = _log(spark, d).groupBy("key").agg(F.max_by(F.struct("op", "seq"), F.struct(*_ORDER)).alias("l"))
    return last.select("key", "l.op", "l.seq")


@query(f"WITH {_LOG}, last AS (SELECT key, arg_max(op, seq) AS op, arg_max(ptr, seq) AS ptr FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log) GROUP BY key) SELECT key, ptr FROM last WHERE op = 'set'")
def kv_at_version(spark, d):
    log = _log(spark, d)
    half = log.agg(F.max("seq")).first()[0] // 2
    return maps.snapshot(log, version=half).select("key", "ptr")


@query(f"{_VIEW} SELECT count(*) AS n_keys FROM view")
def kv_len(spark, d):
    return maps.length(_view(spark, d))


@query(f"{_VIEW} SELECT count(*) AS n_keys FROM view WHERE CAST(substr(key, 6) AS BIGINT) % 3 <> 0")
def kv_delete_then_len(spark, d):
    view = _view(spark, d)
    log = view.select("seq", F.lit("set").alias("op"), "key", "ptr")
    gone = table(spark, d, "events").where("user_id % 3 = 0").select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key")).distinct()
    return maps.length(maps.snapshot(maps.delete_all(log, gone)))


@query(f"{_VIEW} SELECT DISTINCT 'user/' || c_custkey AS key FROM customer WHERE 'user/' || c_custkey NOT IN (SELECT key FROM view)")
def kv_delete_missing(spark, d):
    return maps.missing(_view(spark, d), table(spark, d, "customer").select(F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("key")))


@query(f"{_VIEW} SELECT key, ptr FROM view UNION ALL SELECT 'user/' || s_suppkey, 'f01551220' || sha256(s_name) FROM supplier WHERE 'user/' || s_suppkey NOT IN (SELECT key FROM view)")
def kv_set_if_absent(spark, d):
    log = _view(spark, d).select("seq", F.lit("set").alias("op"), "key", "ptr")
    new = table(spark, d, "supplier").select(F.concat(F.lit("user/"), F.col("s_suppkey").cast("string")).alias("key"), ids.content_id(F.col("s_name")).alias("ptr"))
    return maps.snapshot(maps.set_all(log, new, if_absent=True)).select("key", "ptr")


@query(f"{_VIEW}, old AS (SELECT key, arg_max(op, seq) AS op, arg_max(ptr, seq) AS ptr FROM log WHERE seq < 500 GROUP BY key HAVING arg_max(op, seq) = 'set') SELECT coalesce(o.key, v.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN v.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old o FULL JOIN view v ON o.key = v.key WHERE o.key IS NULL OR v.key IS NULL OR o.ptr <> v.ptr")
def kv_differences(spark, d):
    return maps.differences(maps.snapshot(_log(spark, d), version=499), _view(spark, d))


@query(f"WITH docs AS (SELECT 'doc/' || lang || '/' || doc_id AS key, text FROM documents) SELECT k.key, d.key IS NOT NULL AS found, octet_length(encode(d.text)) AS n_bytes FROM (SELECT 'doc/en/' || doc_id AS key FROM documents) k LEFT JOIN docs d ON d.key = k.key")
def kv_get(spark, d):
    keys = _documents(spark, d).select(F.concat(F.lit("doc/en/"), F.col("doc_id").cast("string")).alias("key"))
    got = maps.get(_document_map(spark, d), _objects(spark, d), keys)
    return got.select("key", "found", F.octet_length("data").cast("long").alias("n_bytes"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def kv_exists(spark, d):
    return maps.exists(_customers(spark, d), _orders(spark, d)).select("o_orderkey")


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def kv_not_exists(spark, d):
    return maps.missing(_customers(spark, d), _orders(spark, d))


def _customers(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))


# --- trie --------------------------------------------------------------------

_KEYS = f"k AS (SELECT 'doc/' || lang || '/' || doc_id AS key, {_TEXT_CID} AS ptr, sha256('doc/' || lang || '/' || doc_id) AS h FROM documents)"
_COUNTS = "c AS (SELECT *, count(*) OVER (PARTITION BY substr(h, 1, 2)) AS c1, count(*) OVER (PARTITION BY substr(h, 1, 4)) AS c2, count(*) OVER (PARTITION BY substr(h, 1, 6)) AS c3 FROM k)"
_PLACED = f"WITH {_KEYS}, {_COUNTS}, placed AS (SELECT key, ptr, h AS hash, d AS depth, substr(h, 1, 2 * d) AS node, CAST('0x' || substr(h, 2 * d + 1, 2) AS INT) AS slot FROM (SELECT *, CASE WHEN c1 <= 4 THEN 0 WHEN c2 <= 4 THEN 1 WHEN c3 <= 4 THEN 2 ELSE 3 END AS d FROM c))"


def _document_map(spark, d):
    key = F.concat_ws("/", F.lit("doc"), "lang", F.col("doc_id").cast("string"))
    return maps.snapshot(maps.map_of(_documents(spark, d), key, "text", F.col("doc_id")))


@query(f"{_PLACED} SELECT * FROM placed")
def trie_layout(spark, d):
    return trie.layout(_document_map(spark, d))


@query(f"{_PLACED} SELECT depth, CAST(sum(n) AS BIGINT) AS n_keys, count(*) AS n_buckets FROM (SELECT depth, node, slot, count(*) AS n FROM placed GROUP BY ALL) GROUP BY depth")
def trie_depth_hist(spark, d):
    return trie.depth_histogram(trie_layout(spark, d))


@query(f"{_PLACED} SELECT n AS n_keys, count(*) AS n_buckets FROM (SELECT count(*) AS n FROM placed GROUP BY node, slot) GROUP BY n")
def trie_bucket_sizes(spark, d):
    return trie.bucket_sizes(trie_layout(spark, d))


_LINKS = "links AS (SELECT DISTINCT substr(hash, 1, 2 * l - 2) AS node, CAST('0x' || substr(hash, 2 * l - 1, 2) AS INT) AS slot, substr(hash, 1, 2 * l) AS child FROM placed, (VALUES (1), (2), (3)) AS t(l) WHERE l <= depth)"


@query(f"{_PLACED}, {_LINKS} SELECT node, slot, 'bucket' AS kind, key, ptr, NULL AS child FROM placed UNION ALL SELECT node, slot, 'link', NULL, NULL, child FROM links")
def trie_nodes(spark, d):
    return trie.deserialize(trie.serialize(trie.nodes(trie_layout(spark, d))))


_ENTRY = "printf('%02x', slot) || '=' || hash || ':' || ptr"
_LEVEL = "SELECT node, sha256(string_agg(e, '|' ORDER BY e)) AS digest FROM ({}) GROUP BY node"


def _merkle_sql() -> str:
    parts = [f"{_PLACED}"]
    below = None
    for depth in (3, 2, 1, 0):
        own = f"SELECT node, {_ENTRY} AS e FROM placed WHERE depth = {depth}"
        if below:
            own += f" UNION ALL SELECT substr(node, 1, {2 * depth}), right(node, 2) || '>' || digest FROM {below}"
        below = f"m{depth}"
        parts.append(f"{below} AS ({_LEVEL.format(own)})")
    return ", ".join(parts) + " SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3"


@query(_merkle_sql())
def trie_merkle(spark, d):
    return trie.merkle(trie_layout(spark, d))


@query(f"SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 2) AS INT) AS b0, CAST(('0x' || substr(sha256(text), 1, 4))::INT >> 11 AS BIGINT) AS five0, CAST((('0x' || substr(sha256(text), 1, 4))::INT >> 6) & 31 AS BIGINT) AS five1 FROM documents")
def trie_extract_bits(spark, d):
    h = ids.key_hash(F.col("text"))
    return _documents(spark, d).select("doc_id", ids.slot(h, 0).alias("b0"), ids.extract_bits(h, 0, 5).alias("five0"), ids.extract_bits(h, 1, 5).alias("five1"))


@query(f"{_PLACED}, {_LINKS} SELECT (SELECT count(*) FROM (SELECT DISTINCT node FROM placed UNION SELECT DISTINCT substr(hash, 1, 2 * l) FROM placed, (VALUES (0), (1), (2), (3)) AS t(l) WHERE l <= depth)) AS n_nodes, (SELECT CAST(sum(strlen('{{\"slot\":' || slot || ',\"kind\":\"' || kind || '\",\"key\":\"' || key || '\",\"ptr\":\"' || ptr || '\",\"child\":\"' || child || '\"}}')) + count(*) + count(DISTINCT node) AS BIGINT) FROM (SELECT node, slot, 'bucket' AS kind, key, ptr, '' AS child FROM placed UNION ALL SELECT node, slot, 'link', '', '', child FROM links)) AS n_bytes")
def trie_node_count(spark, d):
    return trie.serialized_bytes(trie_layout(spark, d))


# --- names ----------------------------------------------------------------------


@query("SELECT url AS key FROM pages WHERE url LIKE 'https://m.%'")
def ns_list_prefix(spark, d):
    return namespace.list_prefix(table(spark, d, "pages").select(F.col("url").alias("key")), "https://m.")


@query("SELECT DISTINCT split_part(substr(key, 5), '/', 1) AS name FROM (SELECT 'doc/' || lang || '/' || doc_id AS key FROM documents)")
def ns_list_dir(spark, d):
    return namespace.list_dir(_document_map(spark, d), "doc/")


@query("SELECT DISTINCT split_part(substr(url, 9), '/', 1) AS name FROM pages WHERE url LIKE 'https://%'")
def ns_list_hosts(spark, d):
    return namespace.list_dir(table(spark, d, "pages").select(F.col("url").alias("key")), "https://")


@query("SELECT DISTINCT event_type || '/zarr.json' AS key FROM events")
def ns_list_metadata(spark, d):
    events = table(spark, d, "events")
    keys = events.select(F.concat(F.col("event_type"), F.lit("/zarr.json")).alias("key")).unionByName(events.select(F.concat(F.col("event_type"), F.lit("/c/0/"), F.col("user_id").cast("string")).alias("key")))
    return namespace.list_keys(keys.distinct(), metadata_only=True)


# --- grids ----------------------------------------------------------------------

_HOUR = f"date_diff('hour', TIMESTAMP '{ORIGIN}', ts)"
_CELLS = f"cells AS (SELECT CAST({_HOUR} AS BIGINT) AS h, user_id AS u, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY ALL)"
_SHAPE = "shape AS (SELECT CAST(max(u) // 10 + 1 AS BIGINT) AS g1, max(u) + 1 AS a1 FROM cells)"
_INDEX = f"WITH {_CELLS}, {_SHAPE}, idx AS (SELECT DISTINCT h // 24 AS c0, u // 10 AS c1, 'f01551220' || sha256((h // 24) || '/' || (u // 10)) AS ptr FROM cells)"


def _cells(spark, d, first: int | None = None, last: int | None = None):
    """Cells by hour and user; with ``first`` and ``last`` the hours between are selected by their time stamps, so that the scan can skip others."""
    hour = F.expr(f"timestampdiff(HOUR, timestamp_ntz'{ORIGIN}', ts)")
    events = table(spark, d, "events")
    events = events if first is None else events.where(f"ts >= timestamp_ntz'{ORIGIN}' + make_dt_interval(0, {first})")
    events = events if last is None else events.where(f"ts < timestamp_ntz'{ORIGIN}' + make_dt_interval(0, {last + 1})")
    return arrays.cells_by(events, {"h": hour, "u": F.col("user_id")}, "value", ("ts", "event_id"))


def _grid(spark, d) -> grid.Grid:
    users = table(spark, d, "events").agg(F.max("user_id")).first()[0]
    return grid.Grid((720, (users or 0) + 1), CHUNK, PER_SHARD)


def _index(spark, d):
    chunked = arrays.rechunk(_cells(spark, d), h=CHUNK[0], u=CHUNK[1]).select("h_chunk", "u_chunk").distinct()
    name = F.concat_ws("/", F.col("h_chunk").cast("string"), F.col("u_chunk").cast("string"))
    return chunked.select(F.lit("value").alias("array"), F.array("h_chunk", "u_chunk").alias("coords"), ids.content_id(name).alias("ptr"))


def _flat(index: DataFrame, *more: str) -> DataFrame:
    return index.select(F.col("coords")[0].alias("c0"), F.col("coords")[1].alias("c1"), *more)


@query("SELECT p_size, CAST(ceil(p_size / 7.0) AS BIGINT) AS c0, CAST(ceil((p_size + 3) / 4.0) AS BIGINT) AS c1, CAST(ceil(p_size / 7.0) * ceil((p_size + 3) / 4.0) AS BIGINT) AS n_chunks, CAST(ceil(ceil(p_size / 7.0) * ceil((p_size + 3) / 4.0) / 5) AS BIGINT) AS n_shards FROM (SELECT DISTINCT p_size FROM part)")
def grid_geometry(spark, d):
    shapes = table(spark, d, "part").select("p_size").distinct().select("p_size", F.array(F.col("p_size").cast("long"), (F.col("p_size") + 3).cast("long")).alias("array_shape"), F.expr("array(7L, 4L)").alias("chunk_shape"), F.lit(5).cast("long").alias("chunks_per_shard"))
    return grid.geometry(shapes).select("p_size", F.col("chunks")[0].alias("c0"), F.col("chunks")[1].alias("c1"), "n_chunks", "n_shards")


@query("""
SELECT DISTINCT key, CASE WHEN chunk THEN event_type END AS array, CASE WHEN chunk THEN user_id % 30 END AS c0, CASE WHEN chunk THEN user_id % 7 END AS c1
FROM (SELECT user_id, event_type, kind = 0 AS chunk, CASE kind WHEN 0 THEN event_type || '/c/' || user_id % 30 || '/' || user_id % 7 WHEN 1 THEN event_type || '/zarr.json' ELSE 'time/c/' || user_id % 30 END AS key
      FROM events, (VALUES (0), (1), (2)) AS t(kind))
""")
def grid_parse_key(spark, d):
    kind = F.explode(F.expr("array(0, 1, 2)"))
    keys = table(spark, d, "events").select("user_id", "event_type", kind.alias("kind"))
    a, b = (F.col("user_id") % 30).cast("string"), (F.col("user_id") % 7).cast("string")
    key = F.when(F.col("kind") == 0, grid.chunk_key(F.col("event_type"), F.array(F.col("user_id") % 30, F.col("user_id") % 7))).when(F.col("kind") == 1, F.concat("event_type", F.lit("/zarr.json"))).otherwise(F.concat(F.lit("time/c/"), a))
    parsed = keys.select(key.alias("key")).distinct().select("key", grid.parse_key(F.col("key")).alias("p"))
    return parsed.select("key", F.col("p.array").alias("array"), F.col("p.coords")[0].alias("c0"), F.col("p.coords")[1].alias("c1"))


@query(f"{_INDEX} SELECT c0, c1, c0 * g1 + c1 AS lin, (c0 * g1 + c1) // 16 AS shard, (c0 * g1 + c1) % 16 AS slot FROM idx, shape")
def grid_linear_index(spark, d):
    return _flat(grid.sharded(_index(spark, d), _grid(spark, d)), "lin", "shard", "slot")


@query(f"{_INDEX}, s AS (SELECT (c0 * g1 + c1) // 16 AS shard, (c0 * g1 + c1) % 16 AS slot, ptr FROM idx, shape) SELECT shard, count(*) AS n_chunks, sha256(string_agg(slot || '=' || ptr, '|' ORDER BY slot)) AS digest FROM s GROUP BY shard")
def grid_shard_stats(spark, d):
    return grid.shard_digests(_index(spark, d), _grid(spark, d)).drop("array")


@query(f"{_INDEX} SELECT c0, c1, CASE WHEN c0 = 3 THEN 'new' ELSE ptr END AS ptr FROM idx WHERE c0 <> 4")
def grid_set_chunks(spark, d):
    index = _index(spark, d)
    new = index.where("coords[0] = 3").withColumn("ptr", F.lit("new")).unionByName(index.where("coords[0] = 4").withColumn("ptr", F.lit(None).cast("string")))
    return _flat(grid.set_chunks(index, new, _grid(spark, d)), "ptr")


@query(f"{_INDEX} SELECT DISTINCT (c0 * g1 + c1) // 16 AS shard FROM idx, shape WHERE c0 IN (3, 4)")
def grid_changed_shards(spark, d):
    index, own = _index(spark, d), _grid(spark, d)
    after = grid.set_chunks(index, index.where("coords[0] in (3, 4)").withColumn("ptr", F.when(F.col("coords")[0] == 3, "new")), own)
    return grid.changed_shards(index, after, own).select("shard")


@query(f"{_INDEX}, q AS (SELECT h AS c0, u AS c1 FROM (SELECT unnest(range(0, 30)) AS h) CROSS JOIN (SELECT unnest(range(0, g1)) AS u FROM shape)) SELECT q.c0, q.c1, CASE WHEN i.c0 IS NOT NULL THEN q.c0 || '/' || q.c1 END AS data FROM q LEFT JOIN idx i ON i.c0 = q.c0 AND i.c1 = q.c1 AND q.c0 % 2 = 0")
def grid_get(spark, d):
    index = _index(spark, d).where("coords[0] % 2 = 0")
    contents = objects.put(_index(spark, d).select(F.array_join(F.transform("coords", lambda c: c.cast("string")), "/").alias("v")), "v")
    own = _grid(spark, d)
    asked = spark.range(own.n_chunks).select(F.lit("value").alias("array"), F.array(F.floor(F.col("id") / own.chunks[1]).cast("long"), F.col("id") % own.chunks[1]).alias("coords"))
    return _flat(grid.get_chunks(asked, index, contents, own), F.col("data").cast("string").alias("data"))


@query(f"{_INDEX} SELECT c0, c1, ptr, c0 * 1 + c1 AS lin FROM idx WHERE c0 < 15 AND c1 < 1")
def grid_resize(spark, d):
    small = _grid(spark, d).resized((360, 10))
    return _flat(grid.sharded(grid.resize(_index(spark, d), small), small), "ptr", "lin")


@query(f"{_INDEX}, src AS (SELECT c0 + 20 AS c0, c1, 'src' || ptr AS ptr FROM idx WHERE c0 < 10 AND c1 = 0) SELECT coalesce(s.c0, t.c0) AS c0, coalesce(s.c1, t.c1) AS c1, coalesce(s.ptr, t.ptr) AS ptr FROM idx t FULL JOIN src s ON s.c0 = t.c0 AND s.c1 = t.c1")
def grid_graft(spark, d):
    index = _index(spark, d)
    source = index.where("coords[0] < 10 and coords[1] = 0").withColumn("ptr", F.concat(F.lit("src"), "ptr"))
    return _flat(grid.graft(index, source, (20, 0), _grid(spark, d)), "ptr")


@query(f"{_INDEX} SELECT c0, c1, ptr FROM idx UNION ALL SELECT c0 + 30, c1, ptr FROM idx")
def grid_append(spark, d):
    own = _grid(spark, d)
    return _flat(grid.append(_index(spark, d), _index(spark, d), own, own)[0], "ptr")


@query(f"{_INDEX} SELECT 'value/c/' || c0 || '/' || c1 AS key, ptr, c0 * g1 + c1 AS lin FROM idx, shape")
def grid_convert(spark, d):
    """From a map of chunk keys to an index and back."""
    view = grid.as_map(_index(spark, d), spark.createDataFrame([("value/zarr.json", "m")], "key string, ptr string"))
    index, metadata = grid.convert(view)
    own = _grid(spark, d)
    back = grid.as_map(index, metadata).where("not key like '%zarr.json'")
    lin = grid.sharded(index, own).select(grid.chunk_key(F.col("array"), F.col("coords")).alias("key"), "lin")
    return back.join(lin, "key")


@query("SELECT p_partkey, p_size AS before0, 7 AS after0, 9 AS after1, p_brand AS brand FROM part")
def grid_metadata_shape(spark, d):
    meta = F.to_json(F.struct(F.array(F.col("p_size"), F.lit(3)).alias("shape"), F.col("p_brand").alias("brand")))
    rows = table(spark, d, "part").select("p_partkey", meta.alias("m")).select("p_partkey", "m", grid.set_shape(F.col("m"), (7, 9)).alias("n"))
    return rows.select("p_partkey", grid.shape_of(F.col("m"))[0].cast("int").alias("before0"), grid.shape_of(F.col("n"))[0].cast("int").alias("after0"), grid.shape_of(F.col("n"))[1].cast("int").alias("after1"), F.get_json_object("n", "$.brand").alias("brand"))


# --- arrays ---------------------------------------------------------------------

_CUBE = f"WITH {_CELLS}"


@query(f"{_CUBE} SELECT * FROM cells WHERE h BETWEEN 100 AND 200")
def arr_sel_range(spark, d):
    return arrays.sel(_cells(spark, d, 100, 200), h=(100, 200))


@query(f"{_CUBE} SELECT * FROM cells WHERE h BETWEEN 100 AND 300 AND u BETWEEN 3 AND 9")
def arr_sel_box(spark, d):
    return arrays.sel(_cells(spark, d, 100, 300), h=(100, 300), u=(3, 9))


@query(f"{_CUBE} SELECT * FROM cells WHERE u = 7")
def arr_sel_exact(spark, d):
    return arrays.sel(_cells(spark, d), u=7)


@query(f"{_CUBE} SELECT * FROM cells WHERE h >= 600")
def arr_sel_open(spark, d):
    return arrays.sel(_cells(spark, d, 600), h=(600, None))


@query("""
WITH l AS (SELECT DISTINCT o_totalprice AS x FROM orders), t AS (SELECT DISTINCT c_acctbal * 25 AS target FROM customer),
 a AS (SELECT t.target, l.x FROM t ASOF LEFT JOIN l ON t.target >= l.x), b AS (SELECT t.target, l.x FROM t ASOF LEFT JOIN l ON t.target <= l.x)
SELECT a.target, CASE WHEN a.x IS NULL OR abs(b.x - a.target) < abs(a.x - a.target) THEN b.x ELSE a.x END AS o_totalprice FROM a JOIN b ON a.target = b.target
""")
def arr_nearest(spark, d):
    targets = table(spark, d, "customer").select((F.col("c_acctbal") * 25).alias("target"))
    return arrays.nearest(table(spark, d, "orders").select("o_totalprice"), "o_totalprice", targets)


@query("SELECT arg_min(o_totalprice, row(abs(o_totalprice - 123456), o_totalprice)) AS o_totalprice FROM orders")
def arr_nearest_one(spark, d):
    return arrays.nearest_one(table(spark, d, "orders"), "o_totalprice", 123456)


@query(f"{_CUBE} SELECT * FROM cells WHERE h >= 10 AND h < 20 AND u = 0")
def arr_isel(spark, d):
    return arrays.isel(_cells(spark, d), h=(10, 20), u=0)


@query(f"{_CUBE} SELECT h, count(*) AS n FROM (SELECT * FROM cells WHERE h < 48 UNION ALL SELECT * FROM cells WHERE h >= 600) WHERE h BETWEEN 40 AND 610 GROUP BY h")
def arr_concat(spark, d):
    cells = _cells(spark, d)
    return arrays.sel(arrays.concat(cells.where("h < 48"), cells.where("h >= 600")), h=(40, 610)).groupBy("h").agg(F.count("*").alias("n"))


@query(f"{_CUBE} SELECT h, u, CASE WHEN h <= (SELECT max(h) FROM cells WHERE h < 300) THEN value ELSE -value END AS value FROM cells")
def arr_stitch(spark, d):
    cells = _cells(spark, d)
    return arrays.stitch(cells.where("h < 300"), cells.withColumn("value", -F.col("value")), "h")


@query(f"{_CUBE} SELECT min(h) AS min_h, max(h) AS max_h, min(u) AS min_u, max(u) AS max_u FROM cells")
def arr_extent(spark, d):
    return arrays.extent(_cells(spark, d), "h", "u")


@query("SELECT event_id AS i FROM (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS p FROM events) WHERE value <= p")
def arr_not_increasing(spark, d):
    return arrays.not_increasing(table(spark, d, "events").select(F.col("event_id").alias("i"), "value"), "i", "value")


@query(f"{_CUBE} SELECT * FROM cells UNION ALL SELECT h + (SELECT max(h) + 1 FROM cells), u, value FROM cells WHERE h < 5")
def arr_append(spark, d):
    cells = _cells(spark, d)
    return arrays.append(cells, cells.where("h < 5"), "h")


@query(f"{_CUBE} SELECT count(*) AS n_different FROM cells WHERE u % 4 = 1")
def arr_differences(spark, d):
    cells = _cells(spark, d)
    changed = cells.where("u % 4 <> 1")
    return arrays.differences(cells, changed).agg(F.count("*").alias("n_different"))


@query(f"{_CUBE} SELECT h // 24 AS h_chunk, u // 10 AS u_chunk, count(*) AS n, max(value) AS top FROM cells GROUP BY ALL")
def arr_rechunk(spark, d):
    return arrays.rechunk(_cells(spark, d), h=24, u=10).groupBy("h_chunk", "u_chunk").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query(f"{_CUBE} SELECT * FROM cells WHERE h BETWEEN 100 AND 200")
def arr_pruned_sel(spark, d):
    """A label range as a range of chunks first, then of labels: the cells lie in a folder for each chunk row, and only those in the range are read."""
    cells = scratch.stored(arrays.rechunk(_cells(spark, d), h=24), "h_chunk")
    hours = spark.range(720).select(F.col("id").alias("h"))
    first, last = arrays.chunks_of(hours, "h", "h", 24, 100, 200).first()
    return arrays.sel(arrays.prune(cells, "h_chunk", first, last), h=(100, 200)).drop("h_chunk")


@query(f"{_CUBE}, days AS (SELECT day AS h_day, name FROM (SELECT unnest(range(0, 30)) AS day, 'day' || unnest(range(0, 30)) AS name)) SELECT name, count(*) AS n FROM cells JOIN days ON h // 24 = h_day GROUP BY name")
def arr_labels(spark, d):
    """From positions to labels: a join with the label table of the dimension."""
    days = spark.range(30).select(F.col("id").alias("h_chunk"), F.concat(F.lit("day"), F.col("id").cast("string")).alias("name"))
    return arrays.rechunk(_cells(spark, d), h=24).join(days, "h_chunk").groupBy("name").agg(F.count("*").alias("n"))


# --- metrics, encryption, streams -----------------------------------------------------


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
 s AS (SELECT event_type, list_sort(list(value)) AS v FROM r WHERE rn <= 2000 GROUP BY event_type), t AS (SELECT event_type, count(*) AS n, avg(value) AS a FROM events GROUP BY event_type)
SELECT event_type, n, round(a, 6) AS avg, CAST(len(v) AS BIGINT) AS n_sample, v[1] AS min, round((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2, 6) AS p50, v[CAST(round_even((len(v) - 1) * 0.95, 0) AS INT) + 1] AS p95, v[CAST(round_even((len(v) - 1) * 0.99, 0) AS INT) + 1] AS p99, v[len(v)] AS max
FROM s JOIN t USING (event_type)
""")
def met_distribution(spark, d):
    found = metrics.distribution(table(spark, d, "events"), "event_type", "value", ("event_id",))
    return found.withColumns({"avg": F.round("avg", 6), "p50": F.round("p50", 6)})


@query("SELECT props, count(*) AS n FROM events GROUP BY props ORDER BY n DESC, props LIMIT 20")
def met_topk(spark, d):
    return metrics.most_common(table(spark, d, "events"), "props", 20)


@query("SELECT CAST(sum(n) AS BIGINT) AS n_requests, count(*) AS n_unique, CAST(sum(n - 1) AS BIGINT) AS n_repeated FROM (SELECT count(*) AS n FROM events GROUP BY props)")
def met_repeats(spark, d):
    return metrics.repeats(table(spark, d, "events"), "props")


@query("SELECT event_type, user_id % 5 AS store, count(*) AS n, CAST(sum(octet_length(encode(props))) AS BIGINT) AS amount FROM events GROUP BY ALL")
def met_counters(spark, d):
    return metrics.counters(table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("store"), F.octet_length("props").cast("long").alias("b")), ["event_type", "store"], "b")


@query("SELECT store, event_type, count(*) FILTER (WHERE value > 20) AS hits, count(*) FILTER (WHERE NOT value > 20) AS misses FROM (SELECT *, user_id % 3 AS store FROM events) GROUP BY CUBE (store, event_type)")
def met_hit_miss_cube(spark, d):
    return metrics.hit_miss(table(spark, d, "events").withColumn("store", F.col("user_id") % 3), "store", "event_type", F.col("value") > 20)


@query("""
WITH s AS (SELECT ts AS t, 1 AS b FROM events UNION ALL SELECT ts + to_seconds(CAST(value * 60 AS BIGINT)), -1 FROM events)
SELECT CAST(max(l) AS BIGINT) AS max_inflight FROM (SELECT sum(b) OVER (ORDER BY t, b ROWS UNBOUNDED PRECEDING) AS l FROM s)
""")
def met_max_inflight(spark, d):
    loads = table(spark, d, "events").select("ts", (F.col("ts") + F.make_dt_interval(secs=F.round(F.col("value") * 60).cast("decimal(18,6)"))).alias("end"))
    return metrics.max_inflight(loads, "ts", "end")


def _secret(text: str):
    return F.unhex(F.sha2(F.lit(text), 256))


@query("SELECT doc_id, sha256(text) AS sha, CAST(octet_length(encode(text)) + 28 AS BIGINT) AS n_sealed FROM documents")
def crypt_roundtrip(spark, d):
    sealed = _documents(spark, d).select("doc_id", crypt.encrypt(F.col("text"), _secret("k"), "header").alias("v"))
    return sealed.select("doc_id", F.sha2(crypt.decrypt(F.col("v"), _secret("k"), "header"), 256).alias("sha"), F.octet_length("v").cast("long").alias("n_sealed"))


@query("SELECT doc_id, true AS refused FROM documents")
def crypt_wrong_header(spark, d):
    sealed = _documents(spark, d).select("doc_id", crypt.encrypt(F.col("text"), _secret("k"), "header").alias("v"))
    return sealed.select("doc_id", (crypt.try_decrypt(F.col("v"), _secret("k"), "other").isNull() & crypt.try_decrypt(F.col("v"), _secret("other"), "header").isNull()).alias("refused"))


@query(f"WITH {_LOG}, last AS (SELECT key, arg_max(op, seq) AS op, arg_max(ptr, seq) AS ptr FROM log GROUP BY key) SELECT key, ptr FROM last WHERE op = 'set'")
def stream_log(spark, d):
    """The events as a stream that commits versions of a log; then the map at the last version."""
    from hashloom.sources.scratch import folder

    base = folder(spark)
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, d, base))
    log = stream.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), ids.content_id(F.col("props")).alias("ptr"))
    log_stream.commit(log, f"{base}/log", f"{base}/state").awaitTermination()
    return maps.snapshot(spark.read.schema(log.schema).parquet(f"{base}/log")).select("key", "ptr")


def _stream_folder(spark, d, base):
    """The events dealt out as files of a folder, as a stream source wants them."""
    table(spark, d, "events").repartition(4, "user_id").write.parquet(f"{base}/events")
    return f"{base}/events"
