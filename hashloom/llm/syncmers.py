"""Document fingerprints from closed syncmers, matched by position.

Of all byte k-mers of a text those are anchors whose least s-mer (by hash) is
their first or their last one. Whether a k-mer is an anchor depends on its own
bytes only, so equal passages have equal anchors at equal distances wherever they
stand. A fingerprint holds all anchors of a text in their order, each as its
32-bit hash and its distance from the one before; anchors that repeat the one
before them are left out. About one byte in twelve begins an anchor.

Two fingerprints are matched by position: anchors of one hash are paired, first
with first and so on, and a pair counts if another one has the same offset from
text to text (a lone anchor has no other to agree with and counts by itself). The
likeness is twice the number of such pairs over the number of anchors of both
texts: about the share of bytes in common passages, and one half for a text with
its second half replaced.

Cases: a null text counts as empty; a text without an anchor (shorter than K
bytes, or a rare longer one) has the hash of the whole text as its only anchor,
so equal texts always have equal fingerprints; a distance of 65,535 or more is
written as 65,535, which begins a stretch whose offsets stand for themselves;
repeated rows with one doc_id follow each other by text; a null doc_id comes last;
``edit_likeness`` needs whole numbers as doc_ids, the others take any type; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from hashloom.llm import textbuf as tb
from hashloom.llm.shared import bounded, texts

S, WIDTH = 8, 24
K = S + WIDTH - 1
FAR = 0xFFFF
#: Rows in one range of doc_ids, and the most ranges; only range bounds pass through the driver.
RANGE_ROWS, MAX_RANGES = 2000, 50_000
_LEAST = -(1 << 63)


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and 32-bit hashes of the closed syncmers of texts that stand one behind the other."""
    n = len(raw) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    view = tb.words64(tb.padded(raw))
    inner = view[: len(raw) - S + 1] * np.uint64(0x9FB21C651E98DF25)
    inner ^= inner >> np.uint64(35)
    inner *= np.uint64(0x9E3779B97F4A7C15)
    inner = (inner >> np.uint64(32)).astype(np.uint32)
    least, span = inner, 1
    while 2 * span <= WIDTH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WIDTH:
        least = np.minimum(least[: len(least) - (WIDTH - span)], least[WIDTH - span :])
    ends = (inner[:n] == least[:n]) | (inner[WIDTH - 1 : WIDTH - 1 + n] == least[:n])
    at = np.flatnonzero(ends)
    doc_end = off[np.searchsorted(off, at, side="right")]
    at = at[at + K <= doc_end]
    h = tb.mix(tb.mix(view[at], view[at + 8]), tb.mix(view[at + 16], view[at + K - 8]))
    return at, (h >> np.uint64(32)).astype(np.uint32)


class Prints:
    """Fingerprints of several texts: hash and gap of each anchor, and the bounds of each text's anchors."""

    def __init__(self, hashes: np.ndarray, gaps: np.ndarray, bounds: np.ndarray):
        self.hashes, self.gaps, self.bounds = hashes, gaps, bounds

    @classmethod
    def of(cls, texts: list[bytes]) -> Prints:
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        at, h = anchors(np.frombuffer(b"".join(texts), np.uint8), off)
        doc = np.searchsorted(off, at, side="right") - 1
        lone = np.flatnonzero(np.bincount(doc, minlength=len(texts)) == 0)
        if len(lone):
            whole = np.frombuffer(b"".join(hashlib.sha256(texts[i]).digest()[:4] for i in lone.tolist()), np.uint32)
            place = np.searchsorted(doc, lone)
            at, h, doc = np.insert(at, place, off[lone]), np.insert(h, place, whole), np.insert(doc, place, lone)
        same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
        keep = np.concatenate(([True], ~same)) if len(doc) else np.zeros(0, bool)
        at, h, doc = at[keep], h[keep], doc[keep]
        first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        gap = np.diff(at, prepend=0)
        gap[first] = at[first] - off[doc[first]]
        return cls(h, np.minimum(gap, FAR).astype(np.uint16), np.searchsorted(doc, np.arange(len(texts) + 1)))

    @classmethod
    def read(cls, fingerprints: list[str]) -> Prints:
        raw = [np.frombuffer(bytes.fromhex(f), np.dtype([("h", ">u4"), ("gap", ">u2")])) for f in fingerprints]
        rows = np.concatenate(raw) if raw else np.zeros(0, np.dtype([("h", ">u4"), ("gap", ">u2")]))
        return cls(rows["h"].astype(np.uint32), rows["gap"].astype(np.uint16), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64))

    def written(self) -> list[str]:
        rows = np.empty(len(self.hashes), np.dtype([("h", ">u4"), ("gap", ">u2")]))
        rows["h"], rows["gap"] = self.hashes, self.gaps
        text = rows.tobytes().hex()
        return [text[12 * a : 12 * b] for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())]

    def taken(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the texts named: number in ``which``, hash, occurrence of the hash, place and stretch of each anchor; and the anchors of each text."""
        size = self.bounds[which + 1] - self.bounds[which]
        owner = np.repeat(np.arange(len(which)), size)
        h, gap = tb.gather(self.hashes, self.bounds[which], size), tb.gather(self.gaps, self.bounds[which], size).astype(np.int64)
        place = np.cumsum(gap)
        stretch = np.cumsum(gap == FAR)
        start = np.minimum(np.cumsum(size) - size, max(0, len(gap) - 1))
        if len(gap):
            place -= (place[start] - gap[start])[owner]
            stretch -= (stretch[start] - (gap[start] == FAR))[owner]
        order = np.lexsort((h, owner))
        new = np.concatenate(([True], (np.diff(h[order].astype(np.int64)) != 0) | (np.diff(owner[order]) != 0))) if len(order) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        times = np.empty(len(order), np.int64)
        times[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        return owner, h, times, place, stretch, size


def likeness(a: Prints, of_a: np.ndarray, b: Prints, of_b: np.ndarray) -> np.ndarray:
    """The likeness of the texts of_a[i] and of_b[i], for every i."""
    own, other = a.taken(of_a), b.taken(of_b)
    pair = np.concatenate((own[0], other[0])).astype(np.uint64) << np.uint64(32) | np.concatenate((own[1], other[1])).astype(np.uint64)
    times = np.concatenate((own[2], other[2]))
    order = np.lexsort((np.arange(len(pair)) >= len(own[0]), times, pair))
    both = np.flatnonzero((pair[order][1:] == pair[order][:-1]) & (times[order][1:] == times[order][:-1]))
    left, right = order[both], order[both + 1] - len(own[0])
    doc = own[0][left]
    offset = own[3][left] - other[3][right]
    side = own[4][left] << 20 | other[4][right]
    by = np.lexsort((side, offset, doc))
    change = np.concatenate(([True], (np.diff(doc[by]) != 0) | (np.diff(offset[by]) != 0) | (np.diff(side[by]) != 0))) if len(by) else np.zeros(0, bool)
    begin = np.flatnonzero(change)
    support = np.repeat(np.diff(np.append(begin, len(by))), np.diff(np.append(begin, len(by))))
    few = np.minimum(own[5], other[5]) == 1
    counted = doc[by][(support > 1) | few[doc[by]]]
    return 2 * np.bincount(counted, minlength=len(of_a)) / np.maximum(own[5] + other[5], 1)


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, position (in bytes) and anchor (its hash): all anchors of every document, as rows to join on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                raw, off = tb.buffers(part.column("text"))
                at, h = anchors(raw, off)
                doc = np.searchsorted(off, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(at - off[doc]), pa.array(h.astype(np.int64))], names=["doc_id", "position", "anchor"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, position long, anchor long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document (no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                found = Prints.of([t.encode() for t in part.column("text").fill_null("").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.written())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _ranged(docs: DataFrame) -> DataFrame:
    """(bucket, helper, key, doc_id, text): rows by ranges of doc_id; each range also gets, as a helper, the first row of the range that follows in descending order, the last one that of the first."""
    keyed = bounded(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = keyed.select("key")
    rows = ids.count()
    n = min(MAX_RANGES, max(1, -(-rows // RANGE_ROWS)))
    shares = [(i + 1) / n for i in range(n - 1)]
    bounds = ids.agg(F.percentile_approx("key", shares, max(10_000, 10 * n))).first()[0] if shares and rows else []
    splits = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf(T.IntegerType())
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, key.to_numpy(), side="left").astype(np.int32))

    tops = dict(ids.select(bucket("key").alias("b"), "key").groupBy("b").agg(F.max("key")).collect())
    held = sorted(tops)
    send = {tops[b]: held[i + 1] if i + 1 < len(held) else held[0] for i, b in enumerate(held)}
    top_keys = np.array(sorted(send), np.int64)
    targets = np.array([send[k] for k in sorted(send)], np.int32)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(key: pd.Series) -> pd.Series:
        k = key.to_numpy()
        own = np.searchsorted(splits, k, side="left").tolist()
        at = np.minimum(np.searchsorted(top_keys, k), max(0, len(top_keys) - 1))
        top = top_keys[at] == k
        return pd.Series([[o, int(targets[a])] if t else [o] for o, a, t in zip(own, at.tolist(), top.tolist())])

    return keyed.select(F.posexplode(places("key")).alias("helper", "bucket"), "key", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "helper", F.desc("key"), "text")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half is the next document's beginning.

    The one shuffle deals the texts out by ranges of doc_id; neighbours across
    ranges come from the helper rows, so no range waits for another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in tb.slices(batch):
                rows = ([before] if before else []) + list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "helper", "bucket"))))
                before = rows[-1]
                first = np.array([i for i in range(len(rows) - 1) if not rows[i][2] and rows[i][3] == rows[i + 1][3]], np.int64)
                edited = []
                for i in first.tolist():
                    text, half = rows[i][1], len(rows[i][1]) // 2
                    edited.append((text[: len(text) - half] + rows[i + 1][1][:half]).encode())
                own, after = Prints.of([r[1].encode() for r in rows]), Prints.of(edited)
                written = own.written()
                columns = [[rows[i][0] for i in first.tolist()], [len(rows[i][1]) for i in first.tolist()], [hashlib.sha256(e).hexdigest() for e in edited]]
                columns += [[written[i] for i in first.tolist()], after.written(), likeness(own, first, after, np.arange(len(first))), likeness(own, first, own, first + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])

    ranged = _ranged(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    fields += [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    return ranged.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
