"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters with word inputs (its log odds in toxic documents and a learned
embedding of its hash) and character inputs (the greatest log odds of its
beginnings of 3 to 8 bytes and the mean of learned embeddings of its byte
trigrams). The network reads windows of ``WINDOW`` words, each overlapping the
one before by half, forwards and backwards; attention pools a window's states
into one logit, and a document's score comes from its most toxic window. All
windows of a text are scored.

Training knows document labels only: each document stands for its most toxic
window so far, a document that is not toxic for a random one besides. The model
is fitted on at most ``TRAIN_ROWS`` labelled rows, by one task, and its size does
not depend on the input.

Cases: a text without words gets the share of toxic rows as its score; null
labels are not learned from, repeated rows once; without labelled rows of both kinds every score is
that share (0 without any row); extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hashloom.llm import sampling, shared, textbuf as tb, words

#: Labelled rows that the network is fitted on, at most.
TRAIN_ROWS = 8000
WINDOW, STRIDE = 32, 16
HIDDEN, CHAR_DIM, WORD_DIM = 8, 6, 4
CHAR_BITS, WORD_BITS = 12, 13
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Documents that a word or beginning must be in: between these bounds, as one in 500 rows.
LEAST_DOCS, MOST_LEAST_DOCS, SHRINK = 3, 6, 4.0
#: Rounds over the sample; more, up to the second number, where it is small, for so many steps about.
EPOCHS, MOST_EPOCHS, LEAST_STEPS, BATCH, RATE = 8, 40, 100, 256, 0.01
DIM = 2 + CHAR_DIM + WORD_DIM
_MASKS = [np.uint64((1 << 8 * n) - 1) for n in range(9) if n < 8] + [np.uint64(0xFFFFFFFFFFFFFFFF)]


def _prefix_hashes(view: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The hash of the words' first n bytes; 0 for shorter words."""
    h = tb.mix(view[begin] & _MASKS[n], np.full(1, n, np.uint64))
    h[size < n] = 0
    return h


def _trigrams(view: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' byte trigrams (a short word has one), and the word of each."""
    count = np.maximum(size - 2, 1)
    word = np.repeat(np.arange(len(size)), count)
    at = begin[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    gram = view[at] & _MASKS[3]
    short = np.flatnonzero(size[word] < 3)
    gram[short] &= np.array([0, 0xFF, 0xFFFF], np.uint64)[size[word[short]]]
    return (tb.mix(gram, np.full(1, 3, np.uint64)) >> np.uint64(64 - CHAR_BITS)).astype(np.int64), word


class Words:
    """Inputs of a set of words: fixed log odds, and the buckets of the learned parts."""

    def __init__(self, odds: dict[str, tuple[np.ndarray, np.ndarray]], view: np.ndarray, begin: np.ndarray, size: np.ndarray):
        h = tb.word_hashes(view, begin, size)
        self.fixed = np.zeros((len(h), 2), np.float32)
        self.fixed[:, 0] = _look(odds["word"], h, 0.0)
        best = np.full(len(h), -9.0, np.float32)
        for n in PREFIXES:
            best = np.maximum(best, _look(odds["prefix"], _prefix_hashes(view, begin, size, n), -9.0))
        self.fixed[:, 1] = np.where(best > -9, best, 0)
        self.bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        self.gram, self.owner = _trigrams(view, begin, size)
        self.grams = np.bincount(self.owner, minlength=len(h)).astype(np.float32)

    def vectors(self, net: dict[str, np.ndarray]) -> np.ndarray:
        out = np.empty((len(self.fixed), DIM), np.float32)
        out[:, :2] = self.fixed
        for k in range(CHAR_DIM):
            out[:, 2 + k] = np.bincount(self.owner, net["chars"][self.gram, k], minlength=len(out)) / self.grams
        out[:, 2 + CHAR_DIM :] = net["words"][self.bucket]
        return out


def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, missing: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(h), missing, np.float32)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], np.float32(missing))


def _log_odds(doc: np.ndarray, h: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key in enough documents: shrunk log odds of toxic documents, against the base rate."""
    some = h > 0
    keys, code = np.unique(h[some], return_inverse=True)
    pair = np.unique(code.astype(np.int64) * len(toxic) + doc[some])
    key, d = pair // len(toxic), pair % len(toxic)
    bad = np.bincount(key, toxic[d], minlength=len(keys))
    all_ = np.bincount(key, minlength=len(keys))
    rate = toxic.mean()
    value = np.log((bad + SHRINK * rate) / (all_ - bad + SHRINK * (1 - rate))) - np.log(rate / (1 - rate))
    keep = all_ >= min(MOST_LEAST_DOCS, max(LEAST_DOCS, len(toxic) // 500))
    return keys[keep], (np.clip(value[keep], -3, 6) / 3).astype(np.float32)


def windows(bounds: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) word numbers, ``pad`` where there is none, and the text of each window; texts without words have none."""
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = bounds[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < bounds[doc + 1][:, None], at, pad), doc


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    net = {"chars": r.normal(0, 0.1, (1 << CHAR_BITS, CHAR_DIM)), "words": r.normal(0, 0.1, (1 << WORD_BITS, WORD_DIM))}
    for d in "fb":
        net[f"x{d}"] = r.normal(0, 0.3, (DIM, 3 * HIDDEN))
        net[f"h{d}"] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        net[f"b{d}"] = np.zeros(3 * HIDDEN)
    net |= {"wa": r.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "va": r.normal(0, 0.3, HIDDEN), "wo": r.normal(0, 0.3, 2 * HIDDEN), "bo": np.array([-1.0])}
    return {k: v.astype(np.float32) for k, v in net.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _recur(gates: np.ndarray, mask: np.ndarray, wh: np.ndarray, order: range, tape: list | None = None) -> np.ndarray:
    """States (time, window, HIDDEN) of one direction from input gates (time, window, 3 * HIDDEN)."""
    h = np.zeros((gates.shape[1], HIDDEN), np.float32)
    out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
    for t in order:
        g = h @ wh
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        new = h + mask[t][:, None] * (new - h)
        if tape is not None:
            tape.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
        h = out[t] = new
    return out


def _pool(states: np.ndarray, mask: np.ndarray, net: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    u = np.tanh(states @ net["wa"])
    s = np.where(mask > 0, u @ net["va"], np.float32(-1e9))
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    c = (a[:, :, None] * states).sum(axis=0)
    return u, a, c, c @ net["wo"] + net["bo"][0]


def logits(gates: dict[str, np.ndarray], at: np.ndarray, pad: int, net: dict[str, np.ndarray], size: int = 2048) -> np.ndarray:
    """One logit a window; ``gates``: each word's input gates by direction, a row of zeros at ``pad``."""
    out = np.empty(len(at), np.float32)
    for base in range(0, len(at), size):
        turn = np.ascontiguousarray(at[base : base + size].T)
        mask = (turn != pad).astype(np.float32)
        states = np.concatenate([_recur(gates[d][turn], mask, net[f"h{d}"], order) for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))], axis=2)
        out[base : base + size] = _pool(states, mask, net)[3]
    return out


def gradients(net: dict[str, np.ndarray], known: Words, x: np.ndarray, turn: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss over a batch; ``turn``: (time, window) word numbers, ``x``: the words' vectors."""
    tapes: dict[str, list] = {"f": [], "b": []}
    xs = x[turn]
    parts = [_recur(xs @ net[f"x{d}"] + net[f"b{d}"], mask, net[f"h{d}"], order, tapes[d]) for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))]
    states = np.concatenate(parts, axis=2)
    u, a, c, logit = _pool(states, mask, net)
    d_logit = weight * (_sigmoid(logit) - y)
    grad = {"wo": c.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
    d_c = d_logit[:, None] * net["wo"]
    d_a = (states * d_c[None]).sum(axis=2)
    d_s = a * (d_a - (a * d_a).sum(axis=0))
    grad["va"] = np.tensordot(d_s, u, ((0, 1), (0, 1)))
    d_u = d_s[:, :, None] * net["va"] * (1 - u * u)
    grad["wa"] = np.tensordot(states, d_u, ((0, 1), (0, 1)))
    d_states = a[:, :, None] * d_c[None] + d_u @ net["wa"].T
    d_x = np.zeros_like(xs)
    for k, d in enumerate("fb"):
        wh, wx = net[f"h{d}"], net[f"x{d}"]
        d_h = np.zeros((turn.shape[1], HIDDEN), np.float32)
        d_wh, d_gates = np.zeros_like(wh), np.zeros((*turn.shape, 3 * HIDDEN), np.float32)
        for t, h, z, r, n, gn in reversed(tapes[d]):
            d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            live = mask[t][:, None]
            d_new = live * d_h
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            d_gates[t] = np.concatenate((d_z, d_r, d_n), axis=1)
            d_g = np.concatenate((d_z, d_r, d_n * r), axis=1)
            d_wh += h.T @ d_g
            d_h = d_h * (1 - live) + d_new * z + d_g @ wh.T
        grad[f"h{d}"] = d_wh
        grad[f"x{d}"] = np.tensordot(xs, d_gates, ((0, 1), (0, 1)))
        grad[f"b{d}"] = d_gates.sum(axis=(0, 1))
        d_x += d_gates @ wx.T
    d_word = np.zeros_like(x)
    np.add.at(d_word, turn.ravel(), d_x.reshape(-1, DIM))
    d_word = d_word[:-1]  # the last row is the pad
    grad["words"], grad["chars"] = np.zeros_like(net["words"]), np.zeros_like(net["chars"])
    used = np.unique(turn[turn < len(d_word)])
    np.add.at(grad["words"], known.bucket[used], d_word[used, 2 + CHAR_DIM :])
    mine = np.zeros(len(d_word), bool)
    mine[used] = True
    pick = mine[known.owner]
    np.add.at(grad["chars"], known.gram[pick], d_word[known.owner[pick], 2 : 2 + CHAR_DIM] / known.grams[known.owner[pick]][:, None])
    return grad


def _gates(x: np.ndarray, net: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {d: x @ net[f"x{d}"] + net[f"b{d}"] for d in "fb"}


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> dict:
    """The fitted model: rate, log odds and network (None without rows of both kinds)."""
    rate = float(toxic.mean()) if len(toxic) else 0.0
    model = {"rate": rate, "odds": None, "net": None}
    if not 0 < rate < 1:
        return model
    pad, begin, end, bounds = words.spans(pa.array(texts, pa.large_string()))
    del texts
    view, size = tb.words64(pad), end - begin
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(bounds))
    h = tb.word_hashes(view, begin, size)
    parts = [_log_odds(doc, _prefix_hashes(view, begin, size, n), toxic) for n in PREFIXES]
    keys, values = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    odds = {"word": _log_odds(doc, h, toxic), "prefix": (keys[order], values[order])}
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    del h, doc
    known = Words(odds, view, begin[first], size[first])
    blank = len(first)
    number = np.append(number, blank)
    at, owner = windows(bounds, len(number) - 1)
    at = number[at].astype(np.int32)
    net, r = initial(seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    hope = np.append(known.fixed.max(axis=1), -9)[at].max(axis=1)
    step = 0
    for epoch in range(max(EPOCHS, min(MOST_EPOCHS, LEAST_STEPS * BATCH // len(toxic)))):
        if epoch:
            x = np.vstack((known.vectors(net), np.zeros((1, DIM), np.float32)))
            hope = logits(_gates(x, net), at, blank, net)
        order = np.lexsort((hope, owner))
        top = order[np.append(owner[order][1:] != owner[order][:-1], True)] if len(order) else order
        other = r.permutation(len(at))[: len(top)]
        other = other[toxic[owner[other]] == 0]
        chosen = r.permutation(np.concatenate((top, other)))
        for base in range(0, len(chosen), BATCH):
            some = chosen[base : base + BATCH]
            turn = np.ascontiguousarray(at[some].T)
            y = toxic[owner[some]].astype(np.float32)
            x = np.vstack((known.vectors(net), np.zeros((1, DIM), np.float32))) if base % (8 * BATCH) == 0 else x
            grad = gradients(net, known, x, turn, (turn != blank).astype(np.float32), y, (1 + y) / len(some))
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model | {"odds": odds, "net": net}


class Scorer:
    """Scores texts; the input gates of recent words are kept in a store of fixed size."""

    STORE = 1 << 16

    def __init__(self, model: dict):
        self.model, self.net = model, model["net"]
        self.cache, self.used = tb.WordCache(17), 0
        self.store = {d: np.zeros((self.STORE, 3 * HIDDEN), np.float32) for d in "fb"}

    def _fresh(self, view: np.ndarray, begin: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        return _gates(Words(self.model["odds"], view, begin, size).vectors(self.net), self.net)

    def _word_gates(self, view: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Each word's row, and the rows; the last one is the pad's."""
        low, high = tb.word_keys(view, begin, size)
        h = tb.mix(low, high)
        brief = size <= tb.KEY_BYTES
        number, known = self.cache.find(low, high, h)
        number = number.astype(np.int64)
        todo = np.flatnonzero(~known & brief)
        rows = [{d: self.store[d] for d in "fb"}]
        total = self.STORE
        if len(todo):
            first, back = tb.distinct(low[todo], high[todo], h[todo])
            own = todo[first]
            fresh = self._fresh(view, begin[own], size[own])
            rows.append(fresh)
            number[todo] = total + back
            total += len(own)
        long = np.flatnonzero(~brief)
        if len(long):
            rows.append(self._fresh(view, begin[long], size[long]))
            number[long] = total + np.arange(len(long))
            total += len(long)
        rows.append({d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"})
        gates = {d: np.concatenate([x[d] for x in rows]) for d in "fb"}
        if len(todo):
            if self.used + len(own) > self.STORE:
                self.cache.clear()
                self.used = 0
            own = own[: self.STORE]
            place = np.arange(self.used, self.used + len(own))
            for d in "fb":
                self.store[d][place] = fresh[d][: len(own)]
            self.used += len(own)
            self.cache.put(low[own], high[own], h[own], place)
        return np.append(number, total), gates

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.model["rate"])
        if self.net is None:
            return out
        pad, begin, end, bounds = words.spans(column)
        number, gates = self._word_gates(tb.words64(pad), begin, end - begin)
        at, doc = windows(bounds, len(number) - 1)
        best = np.full(len(column), -np.inf)
        for base in range(0, len(at), 1 << 15):
            part = slice(base, base + (1 << 15))
            np.maximum.at(best, doc[part], logits(gates, number[at[part]], int(number[-1]), self.net))
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-best)), out)


def train(sample: DataFrame) -> dict:
    """Fit on (doc_id, text, label) rows: one task over the bounded sample."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(i, t, y) for b in batches for i, t, y in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("label").to_pylist())})
        model = fit([t for _, t, _ in rows], np.array([float(y > 0) for *_, y in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("label").cast("double").alias("label"))
    got = rows.repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(bytes(got.model)) if got else fit([], np.zeros(0))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", by: int = 5, out: int = 0, threshold: float = 0.5, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; rows whose crc32 remainder is ``out`` are not learned from."""
    held = sampling.remainder("doc_id", by) == out
    sample = sampling.at_most(sampling.labelled(docs, labels.where(~held), label, bound), bound)
    model = docs.sparkSession.sparkContext.broadcast(train(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for part in tb.slices(batch):
                p = scorer.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shared.texts(docs).withColumn("held_out", F.coalesce(held, F.lit(False))).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
