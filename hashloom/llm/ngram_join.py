"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

1. Each text becomes its set of five-word shingles, and ``BANDS`` hashes of
   ``ROWS`` MinHash values each. Rows with equal sets are collapsed first, so
   copies cost nothing further on.
2. The band hashes are shuffled. Sets that share one are candidates. Each pair of
   candidates is compared in one group just once, though it may share many bands:
   sets that share ``STRONG`` bands with one another's least set form clusters (so
   a family of copies is one group and not one for each band), and a band whose
   sets lie in several clusters is a group of its own, for the pairs across
   clusters that share no such band before. Weak matches do not chain clusters.
3. Groups are verified on the full sets. A large group is cut into blocks of
   bounded size and every pair of blocks is compared apart; the pairs themselves
   never become rows: a group gives, for each member, the number of texts linked
   to it and its least linked member.
4. Classes are the connected components of these verified links.

``band_plan`` chooses bands and rows for the wanted recall at the threshold: with
35 bands of 5 rows a pair at 0.8 is missed with a probability of 1e-6.

Cases: a null text counts as empty; texts without words are linked to nothing and
share a class with equal texts only; texts of fewer than five words have one
shingle; ids need not be unique or known and can be of any type that has an
order, as texts are told apart by their own hashes (a set by 64 bits of one); a
class none of whose rows has a doc_id has a null class_id; extra columns are
ignored by ``near_links`` and kept by ``one_per_class``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hashloom.llm import graph, textbuf as tb, words
from hashloom.llm.shared import bounded, stored

THRESHOLD_9 = 4  # of 9: |A and B| >= 4/9 (|A| + |B|) just when the Jaccard similarity is >= 0.8
#: Bands of ``BANDS`` that a set shares with the least set of those bands if both are to be in one cluster; decides where pairs are compared, not which.
STRONG = 5
#: Members, and shingles, of one block at most (about).
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000
#: Up to so many candidate ids are sent to the tasks that read the texts; beyond, the texts are shuffled to them.
BROADCAST_IDS = 50_000


def band_plan(threshold: float = 0.8, recall: float = 0.999999, rows: int = 5) -> tuple[int, int]:
    """Bands and rows a band, so that a pair at the threshold shares a band with at least this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))), rows


BANDS, ROWS = band_plan()
_A = (np.random.default_rng(20240601).integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = np.random.default_rng(20240602).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) hashes of non-empty sets."""
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            v = flat * _A[k]
            v ^= v >> np.uint32(16)
            v += _B[k]
            h = tb.mix(np.minimum.reduceat(v, start).astype(np.uint64), h)
        out[:, band] = h
    return out


def _text_hash(docs: DataFrame) -> Column:
    """A hash of the text that joins can use, beside text_key."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _text_keys(column: pa.Array) -> list[bytes]:
    raw, off = tb.buffers(column)
    data = raw.tobytes()
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text_key, set_key, node (of set_key), n (shingles) and bands of every document."""
    names = ["doc_id", "text_hash", "text_key", "set_key", "node", "n", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                column = part.column("text")
                text_key = _text_keys(column)
                sets = words.shingle_sets(column)
                set_key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else t for s, t in zip(sets, text_key)]
                some = [k for k, s in enumerate(sets) if len(s)]
                bands: list = [[]] * len(sets)
                if some:
                    for k, row in zip(some, band_hashes([sets[k] for k in some]).view(np.int64)):
                        bands[k] = row
                node = [int.from_bytes(k[:8], "little", signed=True) for k in set_key]
                own = [pa.array(text_key, pa.binary()), pa.array(set_key, pa.binary()), pa.array(node, pa.int64())]
                own += [pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *own], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text"), _text_hash(docs).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, text_key binary, set_key binary, node long, n long, bands array<long>")


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    m = len(sets)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    df = np.bincount(place)
    shared = np.zeros((m, m), np.float32)
    often = df > max(8, m // 16)
    column = np.cumsum(often) - 1
    heavy = often[place]
    width = 2048
    rows, cols = owner[heavy], column[place[heavy]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for base in range(0, int(often.sum()), width):
        a, b = np.searchsorted(cols, (base, base + width))
        x = np.zeros((m, width), np.float32)
        x[rows[a:b], cols[a:b] - base] = 1
        shared += x @ x.T
    light = (df[place] > 1) & ~heavy
    order = np.argsort(place[light], kind="stable")
    p, o = place[light][order], owner[light][order]
    step = 1
    while True:  # pairs of owners of one shingle that stand ``step`` apart
        same = np.flatnonzero(p[step:] == p[:-step]) if len(p) > step else []
        if not len(same):
            return shared
        pair = np.bincount(o[same] * m + o[same + step], minlength=m * m).reshape(m, m)
        shared += pair + pair.T
        step += 1


def _least_linked(linked: np.ndarray) -> np.ndarray:
    """The least member, by place, of each member's linked component."""
    m = len(linked)
    root = np.arange(m)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], m).min(axis=1))
        least = least[least]
        if np.array_equal(least, root):
            return root
        root = least


def _seen_before(group: int, bands: list[list[int]]) -> np.ndarray:
    """Which two members also share a band group with a lower number, where they are compared already."""
    lower = [(k, g) for k, own in enumerate(bands) for g in own if g < group]
    seen = np.zeros((len(bands), len({g for _, g in lower})), np.float32)
    if lower:
        _, column = np.unique([g for _, g in lower], return_inverse=True)
        seen[[k for k, _ in lower], column] = 1
    return seen @ seen.T > 0


def _clusters(inside: DataFrame) -> DataFrame:
    """(node, root) of the sets that share ``STRONG`` bands with the least set of each."""
    strong = inside.where("node > head").groupBy("node", "head").agg(F.count("*").alias("times")).where(F.col("times") >= STRONG)
    return graph.components(strong.select(F.col("node").alias("u"), F.col("head").alias("v")))


def _groups(sets: DataFrame) -> DataFrame:
    """(node, cluster, bands, groups): for each candidate its cluster, its bands that reach over clusters, and all its groups with their numbers of blocks."""
    rows = sets.where("n > 0").select("node", "n", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").select("band", "head")
    inside = stored(rows.join(heads, "band"))
    clusters = _clusters(inside).select("node", "root")
    placed = stored(inside.join(clusters, "node", "left").select("node", "n", "band", F.coalesce("root", "node").alias("cluster")))
    members = [F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("all")]
    across = placed.groupBy("band").agg(F.min("cluster").alias("c"), F.max("cluster").alias("d"), *members).where("c < d")
    across = across.groupBy("size", "low", "high", "all").agg(F.min("band").alias("band")).select("band", F.lit(True).alias("own"))  # bands of the same sets are one group
    of_node = placed.join(across, "band", "left").groupBy("node", "n", "cluster").agg(F.sort_array(F.collect_set(F.when(F.col("own"), F.col("band")))).alias("bands"))
    of_node = stored(of_node)
    parts = of_node.select("node", "n", F.col("cluster").alias("group"), F.lit(False).alias("across")).unionByName(of_node.select("node", "n", F.explode("bands").alias("group"), F.lit(True).alias("across")))
    sizes = parts.groupBy("group", "across").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    sizes = stored(sizes.select("group", "across", F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    lists = parts.join(sizes, ["group", "across"]).groupBy("node").agg(F.collect_list(F.struct("group", "across", "blocks")).alias("groups"))
    return of_node.select("node", "cluster", "bands").join(lists, "node")


def _verified(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, links, root) rows: of each part of a group, its members with the texts linked to them and the least member of their linked component."""
    of = [F.col("of.doc_id").alias("of_id"), F.col("of.text_hash").alias("of_hash"), F.col("of.text_key").alias("of_key")]
    members = stored(sets.select("node", "n_texts", "of").join(_groups(sets), "node").select("node", "n_texts", "cluster", "bands", "groups", *of))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _text_hash(docs).alias("text_hash"))
    few = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    joined = texts.join(few, texts["doc_id"].eqNullSafe(few["of_id"]) & (texts["text_hash"] == few["of_hash"]))
    names = ["node", "n_texts", "cluster", "bands", "groups"]

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                part = part.filter(pa.array([a == b for a, b in zip(_text_keys(part.column("text")), part.column("of_key").to_pylist())], pa.bool_()))
                if part.num_rows:
                    sets_ = [s.tobytes() for s in words.shingle_sets(part.column("text"))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sets_, pa.binary())], names=[*names, "shingles"])

    def compared(key: tuple, rows: dict) -> pa.RecordBatch:
        group, across, left, right = key
        rows = sorted(rows.values(), key=lambda r: r[0])
        node, weight, cluster, block = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        sets_ = [np.frombuffer(r[5], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets_])
        linked = 9 * shared_shingles(sets_) >= THRESHOLD_9 * (size[:, None] + size[None, :])
        np.fill_diagonal(linked, False)
        if left != right:
            linked &= block[:, None] != block[None, :]
        if across:
            linked &= (cluster[:, None] != cluster[None, :]) & ~_seen_before(group, [r[4] for r in rows])
        links = (linked @ weight).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[_least_linked(linked)])], names=["node", "links", "root"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "across", "left", "right", "node", "n_texts", "cluster", "block", "bands", "shingles")]
            for row in zip(*columns):
                if row[:4] != key:
                    if rows:
                        yield compared(key, rows)
                    key, rows = row[:4], {}
                rows[row[4]] = row[4:]  # a text that is repeated counts once
        if rows:
            yield compared(key, rows)

    kinds = "node long, n_texts long, cluster long, bands array<long>, groups array<struct<group: long, across: boolean, blocks: int>>, shingles binary"
    found = joined.select(*names, "of_key", "text").mapInArrow(shingles, kinds)
    block = F.pmod(F.xxhash64("node"), F.col("g.blocks")).cast("int").alias("block")
    parts = found.select("*", F.explode("groups").alias("g")).select("node", "n_texts", "cluster", "bands", "shingles", "g.*", block)
    parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    parts = parts.select("*", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).drop("other", "blocks")
    order = ["group", "across", "left", "right"]
    return parts.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "node long, links long, root long")


def _linked(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text_key, root (of the class), class_id, set_id and n_links of every document."""
    signed = stored(signatures(docs))
    by_text = signed.groupBy("node", "set_key", "text_key").agg(F.min("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "text_hash")).alias("of")
    sets = stored(by_text.groupBy("node", "set_key").agg(of, F.count("*").alias("n_texts"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    found = stored(_verified(docs, sets))
    roots = graph.components(found.where("node > root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0").join(roots, "node")
    ids = sets.select("node", "set_key", F.col("of.doc_id").alias("set_id"), "n_texts")
    linked = stored(ids.join(links, "node"))
    least = stored(linked.groupBy("root").agg(F.min("set_id").alias("least")))
    classes = linked.join(least, "root").select("node", "root", "least", "links")
    of_set = ids.join(classes, "node", "left").select(
        "node", "set_key", "set_id", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("set_id")).otherwise(F.col("least")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"),
    )
    return signed.select("doc_id", "text_hash", "text_key", "node", "set_key").join(stored(of_set), ["node", "set_key"]).drop("node", "set_key")


def near_links(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, set_id, n_links.

    ``set_id`` is the least doc_id with the same shingle set, ``class_id`` the
    least doc_id of all documents connected by links, ``n_links`` the number of
    different other texts whose similarity is 0.8 or more.
    """
    return _linked(docs).select("doc_id", "class_id", "set_id", "n_links")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The documents of which each near-duplicate class keeps the one with the least doc_id.

    Of several texts with that doc_id, or where no row of the class has one, the
    text with the least hash stays. Of repeated rows (one doc_id and text) one stays.
    """
    rows = stored(_linked(docs).groupBy("doc_id", "text_hash", "text_key", "root").agg(F.count("*").alias("times")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    best = stored(rows.groupBy("root").agg(first, F.sum("times").alias("n")).where("n > 1"))  # stored, so that the rows of a large class can be split
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    found = stored(rows.join(best, "root").select("doc_id", "text_hash", stays.alias("stays"), "times").where("not stays or times > 1"))

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["doc_id"].eqNullSafe(right["gone_id"]) & (_text_hash(left) == right["gone_hash"])

    keys = [F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")]
    gone = found.where("not stays").select(*keys)
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same(docs, gone), "left_anti").select(docs.columns)
    again = found.where("stays").select(*keys)
    if again.isEmpty():
        return kept
    single = kept.join(again, same(kept, again), "left_anti").select(docs.columns)
    several = kept.join(again, same(kept, again), "left_semi").select("*", _text_hash(kept).alias("text_hash of row")).dropDuplicates(["doc_id", "text_hash of row"])
    return single.unionByName(several.select(docs.columns))
