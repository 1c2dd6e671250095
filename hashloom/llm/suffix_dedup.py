"""Repeated byte strings by a depth-limited radix sort of suffixes.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere
else, in any document, is removed. Two places start the same string just when
their suffixes agree to ``LENGTH`` bytes, so suffixes are ordered to that depth
only, by most-significant-digit passes, and groups of equals are the repeats.

The first pass must deal out all suffixes, and does so without a row for each:
suffixes are represented by an anchor, the leftmost of the least K-byte strings
(by hash) within their first ``LENGTH`` bytes. Equal suffixes have the same
anchor at the same distance, so the anchor's hash is the leading digit, and a run
of suffixes with one anchor is one row.

1. Rows whose anchor occurs once are done: nothing repeats there.
2. Of the rest, rows that agree in everything their run covers are done too: all
   of their suffixes are repeated.
3. What is left (the rims of repeated passages) is grouped by anchor, with one
   representative of each kind of row from step 2, and its suffixes go through
   the remaining passes of up to seven bytes each; a suffix that is alone in its
   group is dropped at once. Ranks and bytes are packed side by side, so a pass
   compares the bytes themselves. A group of more than ``GROUP`` rows (a passage in
   very many documents) is no job for one task: its suffixes are dealt out at
   once by two 64-bit hashes of all their bytes, which Spark counts with map-side sums.

Which rows agree in all they cover is also decided by two 64-bit hashes.

Cases: a null text counts as empty; documents shorter than ``LENGTH`` bytes keep
everything; repeated rows of one document are copies of each other, so all they
hold is removed; a null doc_id is a value like any other, and ids can be of any
type; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hashloom.llm import textbuf as tb
from hashloom.llm.shared import bounded, stored

LENGTH, K = 200, 64
REACH = LENGTH - K
#: Rows of one anchor that one task sorts, at most; suffixes in one numpy round (about).
GROUP, ROUND = 8192, 400_000
#: Kinds of rows with more than one in so many of all rows (and LEAST_HEAVY rows) are told by a broadcast.
HEAVY, LEAST_HEAVY = 10_000, 1_000
_POS = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 22
_NO_ID = -(1 << 63)


def _strings(pad: np.ndarray, n: int) -> np.ndarray:
    """Hash of the K bytes from each of the first n places on (read past the end: zeros)."""
    h = tb.words64(pad)[: n + K] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 8
    while step < K:
        h = h[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(33)
    return h[: n + 8]


def anchor_rows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every run of suffixes with one anchor: anchor hash, hash of all the run covers, anchor place, first and last suffix."""
    out = []
    for base in range(0, max(1, len(raw)), _BLOCK):
        part = raw[base : base + _BLOCK + LENGTH - 1]
        n = len(part)
        if n < LENGTH:
            continue
        h = _strings(tb.padded(part, K + 16), n)
        low = (h[:n] & ~_POS) | np.arange(n, dtype=np.uint64)
        span, width = 1, REACH + 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        starts = n - LENGTH + 1
        q = (low[:starts] & _POS).astype(np.int64)
        doc = np.searchsorted(off, np.array([base, base + starts]), side="right")
        inner = off[doc[0] : doc[1]] - base  # where other documents begin: suffixes must not reach over it
        edge = np.zeros(starts + 1, np.int32)
        lo, hi = np.clip(inner - LENGTH + 1, 0, starts), np.clip(inner, 0, starts)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        more = off[doc[1] :][: LENGTH] - base
        for x in more[(more < n)]:
            np.add.at(edge, [max(0, x - LENGTH + 1), starts], [1, -1])
        q[np.cumsum(edge[:-1]) > 0] = -1
        change = np.flatnonzero(np.diff(np.concatenate(([-2], q, [-2]))))
        a, b = change[:-1], change[1:] - 1
        keep = q[a] >= 0
        a, b = a[keep], b[keep]
        at = q[a]
        end = b + LENGTH - K
        whole = h[a]
        for place in (np.minimum(a + K, end), np.minimum(a + 2 * K, end), end, np.maximum(a, end - K), np.maximum(a, end - 2 * K)):
            whole = tb.mix(whole, h[place])
        whole = tb.mix(whole, ((at - a) << 8 | (b - a)).astype(np.uint64))
        out.append((h[at], whole, at + base, a + base, b + base))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3


def _number(docs: DataFrame) -> Column:
    """A number for each doc_id: itself, or its hash where it is no whole number. With the text's hash it tells rows apart."""
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce(F.col("doc_id").cast("long") if whole else F.xxhash64(F.col("doc_id").cast("string")), F.lit(_NO_ID))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return bounded(docs).select("doc_id", text).select("doc_id", _number(docs).alias("id"), F.xxhash64("text").alias("version"), "text")


def _anchored(docs: DataFrame) -> DataFrame:
    """(id, version, key, whole, run): run packs the anchor's place and the distances of its first and last suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                raw, off = tb.buffers(part.column("text"))
                key, whole, at, a, b = anchor_rows(raw, off)
                doc = np.searchsorted(off, at, side="right") - 1
                packed = (at - off[doc]) << 16 | (at - a) << 8 | (at - b)
                ids, versions = (np.asarray(part.column(c)) for c in ("id", "version"))
                columns = [ids[doc], versions[doc], key.view(np.int64), whole.view(np.int64), packed]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "version", "key", "whole", "run"])

    return docs.select("id", "version", "text").mapInArrow(run, "id long, version long, key long, whole long, run long")


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id, version, run, single, big, start, bytes): the bytes that each wanted row's suffixes cover.

    doc_id is read too, so that the texts are shuffled once for this and for the last join.
    """
    lists = wanted.groupBy("id", "version").agg(F.collect_list(F.struct("key", "run", "single", "big")).alias("rows"))
    joined = docs.join(lists.hint("shuffle_hash"), ["id", "version"]).select("doc_id", "id", "version", "text", "rows")
    names = ["key", "id", "version", "run", "single", "big", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                raw, off = tb.buffers(part.column("text"))
                data = raw.tobytes()
                rows = part.column("rows")
                flat, size = rows.flatten(), np.diff(np.asarray(rows.offsets))
                doc = np.repeat(np.arange(part.num_rows), size)
                packed = np.asarray(flat.field("run"))
                at = packed >> 16
                a, b = off[doc] + at - (packed >> 8 & 255), off[doc] + at - (packed & 255) + LENGTH
                pieces = [data[x:y] for x, y in zip(a.tolist(), b.tolist())]
                of_doc = [pa.array(np.asarray(part.column(c))[doc]) for c in ("id", "version")]
                yield pa.RecordBatch.from_arrays([flat.field("key"), *of_doc, *(flat.field(c) for c in ("run", "single", "big")), pa.array(pieces, pa.binary())], names=names)

    return joined.mapInArrow(run, "key long, id long, version long, run long, single boolean, big boolean, bytes binary")


def _suffixes(packed: np.ndarray, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the rows: row, distance to the anchor, place in the joined bytes; and those bytes, padded."""
    raw, off = tb.buffers(pieces)
    count = (packed >> 8 & 255) - (packed & 255) + 1
    row = np.repeat(np.arange(len(packed)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, (packed[row] >> 8 & 255) - nth, off[row] + nth, tb.padded(raw)


def repeated_suffixes(group: np.ndarray, packed: np.ndarray, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of the suffixes that another row of the same group has too: digit by digit, groups of one are dropped."""
    row, distance, place, pad = _suffixes(packed, pieces)
    view = tb.words64(pad)
    rank = group[row] * (REACH + 2) + distance
    done = 0
    while True:
        _, rank, count = np.unique(rank, return_inverse=True, return_counts=True)
        more = count[rank] > 1
        row, distance, place, rank = row[more], distance[more], place[more], rank[more]
        if done == LENGTH or not len(rank):
            return row, distance
        digit = min((64 - int(rank.max()).bit_length()) // 8, 7, LENGTH - done)  # bytes that fit beside the rank
        own = view[place + done] & np.uint64((1 << 8 * digit) - 1)
        rank = rank.astype(np.uint64) << np.uint64(8 * digit) | own
        done += digit


def _intervals(ids: np.ndarray, versions: np.ndarray, packed: np.ndarray, row: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    """(id, version, lo, hi) of the runs of repeated suffixes of each row."""
    order = np.lexsort((-distance, row))
    row, start = row[order], (packed[row] >> 16)[order] - distance[order]
    new = np.concatenate(([True], (np.diff(row) != 0) | (np.diff(start) != 1))) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    columns = [ids[row[first]], versions[row[first]], start[first], start[last] + LENGTH]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "version", "lo", "hi"])


def _sorted_groups(around: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.RecordBatch) -> pa.RecordBatch:
            key, packed, single = (np.asarray(table.column(c)) for c in ("key", "run", "single"))
            group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            row, distance = repeated_suffixes(group, packed, table.column("bytes"))
            own = single[row]
            return _intervals(np.asarray(table.column("id")), np.asarray(table.column("version")), packed, row[own], distance[own])

        for batch in batches:
            for base in range(0, batch.num_rows, ROUND // (REACH + 1)):
                held.append(batch.slice(base, ROUND // (REACH + 1)))
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key = np.asarray(table.column("key"))
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield flush(table.slice(0, cut))
                held = [table.slice(cut)]
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    rows = around.where("not big").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "id long, version long, lo long, hi long")


def _counted_groups(around: DataFrame) -> DataFrame:
    """Rows of very frequent anchors: one row a suffix, counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in range(0, batch.num_rows, 1024):
                part = batch.slice(base, 1024)
                packed = np.asarray(part.column("run"))
                row, distance, place, pad = _suffixes(packed, part.column("bytes"))
                view = tb.words64(pad)
                one, two = np.zeros(len(row), np.uint64), distance.astype(np.uint64)
                for digit in range(LENGTH // 8):
                    one, two = tb.mix(one, view[place + 8 * digit]), tb.mix(two, view[place + 8 * digit] ^ one)
                start = (packed[row] >> 16) - distance
                of_row = [pa.array(np.asarray(part.column(c))[row]) for c in ("id", "version", "single")]
                yield pa.RecordBatch.from_arrays([*of_row, pa.array(start), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["id", "version", "single", "lo", "one", "two"])

    rows = around.where("big").mapInArrow(run, "id long, version long, single boolean, lo long, one long, two long")
    again = rows.groupBy("one", "two").agg(F.count("*").alias("times")).where("times > 1").select("one", "two")
    return rows.where("single").join(again, ["one", "two"]).select("id", "version", "lo", (F.col("lo") + LENGTH).alias("hi"))


def _of_repeated(shared: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows of the kinds that occur more than once.

    The most frequent kinds are found by a broadcast: as each has more than one
    in ``HEAVY`` of all rows, there are less than ``HEAVY`` of them, whatever the input.
    """
    most = max(LEAST_HEAVY, shared.count() // HEAVY)
    heavy = kinds.where(F.col("times") > most).select("key", "whole", F.lit(True).alias("heavy"))
    marked = shared.join(F.broadcast(heavy), ["key", "whole"], "left")
    repeated = kinds.where((F.col("times") > 1) & (F.col("times") <= most)).select("key", "whole")
    return marked.where("heavy").drop("heavy").unionByName(marked.where("heavy is null").drop("heavy").join(repeated, ["key", "whole"]))


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with ``texts`` also kept (binary) and spans (array of lo, hi)."""
    kind, arrow_kind = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    docs = _keyed(docs)
    rows = _anchored(docs)
    # Stored, so that both sides of the join are shuffles and a hot anchor's rows can be split.
    often = stored(rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"))
    shared = stored(rows.join(often, "key"))
    kinds = stored(shared.groupBy("key", "whole").agg(F.count("*").alias("times"), F.min(F.struct("id", "version", "run")).alias("one")))
    full = _of_repeated(shared, kinds)
    full = full.select("id", "version", (F.shiftright("run", 16) - F.shiftright("run", 8).bitwiseAND(255)).alias("lo"), (F.shiftright("run", 16) - F.col("run").bitwiseAND(255) + LENGTH).alias("hi"))
    open_ = kinds.groupBy("key").agg(F.count("*").alias("members"), F.count_if(F.col("times") == 1).alias("singles")).where("singles > 0 and members > 1")
    wanted = kinds.join(stored(open_), "key").select("key", "one.*", (F.col("times") == 1).alias("single"), (F.col("members") > GROUP).alias("big"))
    around = _surroundings(docs, wanted)
    spans = full.unionByName(_sorted_groups(around)).unionByName(_counted_groups(around))
    spans = spans.groupBy("id", "version").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = docs.join(spans.hint("shuffle_hash"), ["id", "version"], "left").select("doc_id", "id", "version", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if texts else [])]
    span_kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                raw, off = tb.buffers(part.column("text"))
                lists = part.column("spans")
                found = lists.is_valid().to_numpy(zero_copy_only=False)
                size = np.where(found, lists.value_lengths().fill_null(0).to_numpy(), 0)
                flat = lists.flatten()
                doc = np.repeat(np.arange(part.num_rows), size)
                cover = np.zeros(len(raw) + 1, np.int64)
                np.add.at(cover, np.asarray(flat.field("lo")) + off[doc], 1)
                np.add.at(cover, np.asarray(flat.field("hi")) + off[doc], -1)
                gone = np.cumsum(cover[:-1]) > 0
                out = []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                    own = gone[a:b]
                    kept = raw[a:b][~own].tobytes()
                    lo, hi = tb.runs(own)
                    row = (b - a, b - a - len(kept), len(lo), hashlib.sha256(kept).hexdigest())
                    out.append((*row, kept, [{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist())]) if texts else row)
                kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span_kind]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(arrow_kind), *(pa.array(c, k) for c, k in zip(zip(*out), kinds_))], names=names)

    more = ", kept binary, spans array<struct<lo: long, hi: long>>" if texts else ""
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
