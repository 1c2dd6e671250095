"""Quality classifier: logistic regression on hashed word n-grams, learned with follow-the-regularised-leader updates.

Words are runs of letters, digits and non-ASCII characters, or runs of signs;
upper and lower case differ, and every byte of a word counts. A document's features are the relative frequencies
of its hashed single words and word pairs (a word that is repeated at once has a
bucket of its own), so its score is a sparse dot product that is summed while
the words go by.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, by one task, and is
``2 ** BITS`` weights large whatever the input; every document is scored.

Cases: a null or empty text has no features and gets the score of the intercept;
null labels are not learned from, repeated rows once; without any labelled row
every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hashloom.llm import sampling, textbuf as tb
from hashloom.llm.shared import texts

BITS = 18
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.02
SCALE = 8.0
_KIND = np.array([1 if chr(c).isalnum() or c >= 0x80 else 2 if 0x20 < c < 0x7F else 0 for c in range(256)], np.uint8)
_SAME = np.uint64(0x5EED)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the text each belongs to (one row for each occurrence)."""
    raw, off = tb.buffers(column)
    pad = tb.padded(raw)
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    begin = np.flatnonzero(edge)
    end = begin[1:]
    begin = begin[:-1]
    word = kind[begin] > 0 if len(begin) else np.zeros(0, bool)
    begin, end = begin[word], end[word]
    doc = np.searchsorted(off, begin, side="right") - 1
    one = tb.word_hashes(tb.words64(pad), begin, end - begin)
    two = tb.mix(one[:-1], one[1:] ^ np.uint64(0xABCDEF))
    two[one[:-1] == one[1:]] = tb.mix(_SAME[None], _SAME[None])
    inside = doc[:-1] == doc[1:]
    shift = np.uint64(64 - BITS)
    return np.concatenate((one >> shift, two[inside] >> shift)).astype(np.int64), np.concatenate((doc, doc[:-1][inside]))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and intercept from (buckets, values, label) rows, in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    bias = 0.0
    for _ in range(EPOCHS):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            bias = -zb / ((BETA + nb**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30)))
            g = (p - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            gb = p - y
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += gb * gb
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w.astype(np.float32), float(bias)


def train(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on (doc_id, text, label) rows: features where the rows are, the updates in one task over the bounded sample."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                at, doc = features(part.column("text"))
                lists, values = [], []
                keyed, counts = np.unique(doc << 32 | at, return_counts=True)
                bounds = np.searchsorted(keyed, np.arange(part.num_rows + 1) << 32)
                total = np.bincount(doc, minlength=part.num_rows)
                for d in range(part.num_rows):
                    a, b = bounds[d], bounds[d + 1]
                    lists.append((keyed[a:b] & 0xFFFFFFFF).astype(np.int32))
                    values.append((SCALE * counts[a:b] / max(1, total[d])).astype(np.float32))
                columns = [part.column("doc_id"), part.column("label").cast(pa.float64()), pa.array(lists, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, labels = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
            at, x = batch.column("at"), batch.column("x")
            rows += [(i, np.asarray(at[k].values), np.asarray(x[k].values, np.float64), y) for k, (i, y) in enumerate(zip(ids, labels))]
        rows.sort(key=lambda r: (zlib.crc32(r[0].encode()), r[0], r[3], r[1].tobytes(), r[2].tobytes()))  # not the order of arrival
        w, bias = fit([r[1:] for r in rows]) if rows else (np.zeros(1 << BITS, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    rows = sample.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(extract, "doc_id string, label double, at array<int>, x array<float>")
    got = rows.repartition(1).mapInArrow(learn, "w binary, bias double").first()
    return (np.frombuffer(bytes(got.w), np.float32), got.bias) if got else fit([])


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", by: int = 4, out: int = 2, threshold: float = 0.7, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; rows whose crc32 remainder is ``out`` are not learned from."""
    held = sampling.remainder("doc_id", by) == out
    weights, bias = train(sampling.at_most(sampling.labelled(docs, labels.where(~held), label, bound), bound))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            for part in tb.slices(batch):
                at, doc = features(part.column("text"))
                n = np.bincount(doc, minlength=part.num_rows)
                logit = SCALE * np.bincount(doc, w[at], minlength=part.num_rows) / np.maximum(n, 1) + bias
                p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).withColumn("held_out", F.coalesce(held, F.lit(False))).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
