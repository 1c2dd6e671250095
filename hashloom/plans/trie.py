"""The 256-way hash trie of a map, computed from its key set.

With buckets of at most M keys, a key lives at the least depth d at which no more
than M keys share its first d + 1 hash bytes. In the order of their hashes, a
prefix is shared by more than M keys just when it is shared by a key and the M-th
behind it; so a key's depth is the longest prefix that any M + 1 neighbours, it
among them, have in common. One shuffle deals the keys out by their first two
bytes; prefixes of one byte are counted (256 rows at most, broadcast). The layout
depends on the set of keys only, not on the order of their changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from hashloom.functions import ids
from hashloom.sources import scratch

BUCKET = 4
#: The trie cannot be deeper than the hash has bytes.
MAX_LEVELS = 32
#: Bytes that ``hash`` and ``ahead`` have in common from the start.
_COMMON = f"aggregate(sequence(1, {MAX_LEVELS - 1}), 0, (n, l) -> if(n = l - 1 and substr(hash, 2 * l - 1, 2) = substr(ahead, 2 * l - 1, 2), l, n))"


def layout(view: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, ptr, hash, depth, node, slot) of every key: ``node`` is the hex path of the node that holds it."""
    if bucket < 1:
        raise ValueError("a bucket holds one key at least")
    keys = view.select("key", "ptr", ids.key_hash(F.col("key")).alias("hash"))
    first = keys.groupBy(ids.prefix(F.col("hash"), 1).alias("p")).agg((F.count("*") > bucket).alias("full"))
    by = Window.partitionBy(ids.prefix(F.col("hash"), 2)).orderBy("hash", "key")
    ahead = keys.select("*", F.lead("hash", bucket).over(by).alias("ahead"))
    shared = F.when(ids.prefix(F.col("hash"), 3) != ids.prefix(F.col("ahead"), 3), F.lit(2)).when(F.col("ahead").isNotNull(), F.expr(_COMMON))
    run = ahead.select("key", "ptr", "hash", F.max(shared).over(by.rowsBetween(-bucket, 0)).alias("deep"))
    placed = run.join(F.broadcast(first), ids.prefix(F.col("hash"), 1) == F.col("p"))
    placed = placed.select("key", "ptr", "hash", F.coalesce("deep", F.col("full").cast("int")).alias("depth"))
    return placed.select("*", F.substr("hash", F.lit(1), F.col("depth") * 2).alias("node"), ids.slot(F.col("hash"), F.col("depth")).alias("slot"))


def links(placed: DataFrame) -> DataFrame:
    """(node, slot, child) of every link: each node but the root hangs at its parent."""
    node = placed.where("depth > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda d: F.substr(F.col("hash"), F.lit(1), d * 2))).alias("child")).distinct()
    parent = F.substr("child", F.lit(1), F.length("child") - 2)
    return node.select(parent.alias("node"), F.conv(F.right("child", F.lit(2)), 16, 10).cast("int").alias("slot"), "child")


def nodes(placed: DataFrame) -> DataFrame:
    """(node, slot, kind, key, ptr, child) rows of all used slots; empty slots have no row."""
    empty = F.lit(None).cast("string")
    buckets = placed.select("node", "slot", F.lit("bucket").alias("kind"), "key", "ptr", empty.alias("child"))
    return buckets.unionByName(links(placed).select("node", "slot", F.lit("link").alias("kind"), empty.alias("key"), empty.alias("ptr"), "child"))


def depth_histogram(placed: DataFrame) -> DataFrame:
    by_bucket = placed.groupBy("depth", "node", "slot").agg(F.count("*").alias("n"))
    return by_bucket.groupBy("depth").agg(F.sum("n").alias("n_keys"), F.count("*").alias("n_buckets"))


def bucket_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("node", "slot").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_buckets")).withColumnRenamed("n", "n_keys")


def serialize(node_rows: DataFrame) -> DataFrame:
    """(node, body): each node as JSON, its slots in order and the keys of a bucket in order."""
    entry = F.struct("slot", "kind", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("ptr", F.lit("")).alias("ptr"), F.coalesce("child", F.lit("")).alias("child"))
    return node_rows.groupBy("node").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("body"))


def deserialize(bodies: DataFrame) -> DataFrame:
    """The rows of serialized nodes; a body that is not such JSON is an error."""
    kind = "array<struct<slot: int, kind: string, key: string, ptr: string, child: string>>"
    entries = bodies.select("node", F.explode(F.from_json("body", kind, {"mode": "FAILFAST"})).alias("e")).select("node", "e.*")
    given = lambda c, k: F.when(F.col("kind") == k, F.col(c)).alias(c)
    return entries.select("node", "slot", "kind", given("key", "bucket"), given("ptr", "bucket"), given("child", "link"))


def merkle(placed: DataFrame) -> DataFrame:
    """(node, digest) of every node; the digest at node '' identifies the whole map.

    A node's digest is the SHA-256 of its sorted entries, joined by '|': for a
    key its slot, key hash and pointer, for a link its slot and the child's
    digest. One aggregate a level, deepest first; a node has at most 256 times
    the bucket size entries. What a level gives is stored, as two uses need it.
    """
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    entries = placed.select("depth", "node", F.concat(two(F.col("slot")), F.lit("="), "hash", F.lit(":"), F.coalesce("ptr", F.lit("-"))).alias("entry"))
    entries = scratch.stored(entries)
    deepest = entries.agg(F.max("depth")).first()[0]
    if deepest is None:
        return placed.sparkSession.createDataFrame([], "node string, digest string")
    levels, below = [], None
    for depth in range(deepest, -1, -1):
        own = entries.where(F.col("depth") == depth).select("node", "entry")
        if below is not None:
            parent = F.substr("node", F.lit(1), F.length("node") - 2)
            own = own.unionByName(below.select(parent.alias("node"), F.concat(F.right("node", F.lit(2)), F.lit(">"), "digest").alias("entry")))
        below = scratch.stored(own.groupBy("node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("entry")), "|"), 256).alias("digest")))
        levels.append(below)
    return reduce(DataFrame.unionByName, levels)


def serialized_bytes(placed: DataFrame) -> DataFrame:
    """Number of nodes and bytes of all serialized nodes."""
    return serialize(nodes(placed)).agg(F.count("*").alias("n_nodes"), F.sum(F.octet_length("body")).cast("long").alias("n_bytes"))
