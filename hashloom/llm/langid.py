"""Language identification: words first, then progressively shorter character n-grams.

A word seen in training scores with its per-language log frequency. An unseen
word backs off: at each of its characters the longest known n-gram that ends
there (four characters down to one, word start included) scores, and the word
gets ``BACKOFF`` times the mean over its characters. A document's language is the
one with the greatest sum; the score is its share after a softmax. Words are runs
of ASCII letters and non-ASCII characters, in lower case; they are told apart by
64-bit hashes of all their bytes, n-grams by hashes of their characters.

The frequencies come from at most ``TRAIN_ROWS`` documents with a language (those
whose hashed doc_id is least). All that is counted there is kept, so the model's
size is bounded by those rows.

Cases: a text that is null or has no letter gets ``und`` and score 0; a null
lang is not learned from; with nothing to learn from every document gets ``und``;
ties go to the language that sorts first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from hashloom.llm import sampling, textbuf as tb
from hashloom.llm.shared import bounded, texts

#: Labelled documents that the frequencies are counted over, at most.
TRAIN_ROWS = 20_000
ORDERS = (4, 3, 2, 1)
BACKOFF = 1.5
#: Text bytes counted at a time, and keys of one table that a task holds before it passes them on.
COUNT_BYTES, HELD_KEYS = 1 << 18, 60_000
_LETTER = np.array([chr(c).isalpha() and c < 0x80 or c >= 0x80 for c in range(256)])
_MARK = ord("_")


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with a mark before and zeros behind; word starts, ends and texts."""
    raw, off = tb.buffers(pc.utf8_lower(column))
    pad = tb.padded(np.concatenate((np.array([_MARK], np.uint8), raw)))
    inside = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[off] = True
    begin = np.flatnonzero(edge)
    end = begin[1:]
    begin = begin[:-1]
    keep = inside[begin] if len(begin) else np.zeros(0, bool)
    begin, end = begin[keep], end[keep]
    return pad, begin + 1, end + 1, np.searchsorted(off, begin, side="right") - 1


def grams(pad: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every character of the words: the word's number, and for each order the hash of the n-gram that ends there (0: none).

    A mark before a word counts as its first character.
    """
    flat = tb.gather(pad, begin - 1, size + 1)
    at = np.cumsum(size + 1) - size - 1
    flat[at] = _MARK
    start = np.flatnonzero((flat & 0xC0) != 0x80)
    width = np.diff(np.append(start, len(flat)))
    char = tb.words64(tb.padded(flat))[start] & ((np.uint64(1) << (8 * np.minimum(width, 7)).astype(np.uint64)) - np.uint64(1))
    word = np.repeat(np.arange(len(size)), size + 1)[start]
    place = np.arange(len(start)) - np.searchsorted(start, at)[word]
    inner = place > 0
    out: dict[int, np.ndarray] = {}
    h = tb.mix(char, np.ones(1, np.uint64))
    for n in range(1, max(ORDERS) + 1):
        if n > 1:  # the n-gram is the one before, one character shorter, and this character
            h[1:] = tb.mix(h[:-1] + np.uint64(n), char[1:])
        out[n] = np.where(place + 1 >= n, h, np.uint64(0))[inner]
    return word[inner], [out[n] for n in ORDERS]


class Model:
    """Log frequencies of words (order 0) and n-grams by language."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, {}
        for order, (keys, counts) in tables.items():
            by = np.argsort(keys)
            total = counts.sum(axis=0)
            self.tables[order] = keys[by], np.log((counts[by] + 0.5) / (total + 0.5 * len(keys) + 1.0)).astype(np.float32)

    def _find(self, order: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, logs = self.tables.get(order, (np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.float32)))
        if not len(keys):
            return np.zeros((len(h), len(self.langs)), np.float32), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return logs[at], keys[at] == h

    def vectors(self, pad: np.ndarray, begin: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        out, known = self._find(0, h)
        out = out.copy()
        rest = np.flatnonzero(~known)
        if len(rest):
            word, hashes = grams(pad, begin[rest], size[rest])
            chars = np.bincount(word, minlength=len(rest))
            logs = np.zeros((len(word), len(self.langs)), np.float32)
            open_ = np.ones(len(word), bool)
            for order, g in zip(ORDERS, hashes):
                todo = np.flatnonzero(open_)
                found, hit = self._find(order, g[todo])
                logs[todo[hit]] = found[hit]
                open_[todo[hit]] = False
            for k in range(len(self.langs)):
                out[rest, k] = BACKOFF * np.bincount(word, logs[:, k], minlength=len(rest)) / chars
        return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _counts(order: int, lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), pa.array([lang] * len(keys), pa.string()), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["ord", "key", "lang", "n"])


def train(sample: DataFrame) -> Model | None:
    """Count words and n-grams of (text, label) rows by language; the counts are summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part in tb.slices(batch, limit=COUNT_BYTES):
                pad, begin, end, doc = words(part.column("text"))
                label = part.column("label").dictionary_encode()
                lang, names = np.asarray(label.indices)[doc], label.dictionary.to_pylist()
                h = tb.word_hashes(tb.words64(pad), begin, end - begin)
                word, hashes = grams(pad, begin, end - begin)
                for order, key, own in ((0, h, lang), *((n, g, lang[word]) for n, g in zip(ORDERS, hashes))):
                    for k, name in enumerate(names):
                        keys, n = np.unique(key[(own == k) & (key > 0)], return_counts=True)
                        own_counts = held.setdefault((order, name), [])
                        own_counts.append((keys, n))
                        if sum(len(x) for x, _ in own_counts) > HELD_KEYS:
                            merged = _merged(own_counts)
                            if len(merged[0]) > HELD_KEYS // 2:
                                yield _counts(order, name, *merged)
                                merged = merged[0][:0], merged[1][:0]
                            held[order, name] = [merged]
        for (order, name), own_counts in held.items():
            yield _counts(order, name, *_merged(own_counts))

    counts = sample.mapInArrow(count, "ord int, key long, lang string, n long").groupBy("ord", "key", "lang").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return None
    order, key, n = (table.column(c).to_numpy() for c in ("ord", "key", "n"))
    lang = np.searchsorted(np.array(langs), np.array(table.column("lang").to_pylist()))
    tables = {}
    for o in np.unique(order).tolist():
        own = order == o
        keys, at = np.unique(key[own].view(np.uint64), return_inverse=True)
        counts_ = np.zeros((len(keys), len(langs)))
        counts_[at, lang[own]] = n[own]
        tables[o] = keys, counts_
    return Model(langs, tables)


class Scorer:
    """Scores texts; the vectors of recent words are remembered in a store of fixed size."""

    STORE = 1 << 18

    def __init__(self, model: Model):
        self.model = model
        self.cache, self.used = tb.WordCache(18), 0
        self.store = np.zeros((self.STORE, len(model.langs)), np.float32)

    def _word_vectors(self, pad: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        low, high = tb.word_keys(tb.words64(pad), begin, size)
        h = tb.word_hashes(tb.words64(pad), begin, size)
        number, known = self.cache.find(low, high, h)
        known &= size <= tb.KEY_BYTES
        out = self.store[number]
        todo = np.flatnonzero(~known & (size <= tb.KEY_BYTES))
        if len(todo):
            first, back = tb.distinct(low[todo], high[todo], h[todo])
            own = todo[first]
            fresh = self.model.vectors(pad, begin[own], size[own], h[own])
            out[todo] = fresh[back]
            if self.used + len(own) > self.STORE:
                self.cache.clear()
                self.used = 0
            own, fresh = own[: self.STORE], fresh[: self.STORE]
            place = np.arange(self.used, self.used + len(own))
            self.store[place] = fresh
            self.used += len(own)
            self.cache.put(low[own], high[own], h[own], place)
        long = np.flatnonzero(size > tb.KEY_BYTES)
        if len(long):
            out[long] = self.model.vectors(pad, begin[long], size[long], h[long])
        return out

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        pad, begin, end, doc = words(column)
        rows, langs = len(column), self.model.langs
        vectors = self._word_vectors(pad, begin, end - begin)
        total = np.stack([np.bincount(doc, vectors[:, k], minlength=rows) for k in range(len(langs))], axis=1)
        ascii_letter = np.bincount(doc, pad[begin] < 0x80, minlength=rows) > 0
        some = np.bincount(doc, minlength=rows) > 0
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = [langs[b] for b in best.tolist()]
        for i in np.flatnonzero(~ascii_letter).tolist():
            if not some[i] or not regex.search(r"\p{L}", column[i].as_py() or ""):
                names[i], share[i] = "und", 0.0
        return names, share


def identify(docs: DataFrame, by: int = 3, out: int = 1, bound: int = TRAIN_ROWS, keep: bool = False, prefix: str = "") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; rows whose crc32 remainder is ``out`` are not learned from.

    ``keep``: return the columns of ``docs`` and the three behind them (columns of these names are replaced);
    ``prefix`` goes before the three names.
    """
    held = sampling.remainder("doc_id", by) == out
    labels = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held)
    model = train(sampling.labelled(docs, labels, "lang", bound))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [prefix + c for c in ("held_out", "lang_pred", "score")]
    base = bounded(docs).drop(*more) if keep else texts(docs)
    base = base.withColumn(more[0], F.coalesce(held, F.lit(False)))
    names = [c for c in base.columns if keep or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            for part in tb.slices(batch):
                langs, scores = scorer.score(part.column("text")) if scorer else (["und"] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores)], names=[*names, *more[1:]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in names)
    return base.mapInArrow(run, f"{schema}, `{more[1]}` string, `{more[2]}` double")
