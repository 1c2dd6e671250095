"""Benchmark decontamination with a generalised suffix automaton.

The items' word sequences go into one suffix automaton. Document words are
mapped to the automaton's alphabet; a word outside it, or a word pair that has
no path from the root, ends every match, so only stretches that are long enough
to hold a window are streamed through the automaton, which gives for each word
the length of the longest item passage that ends there. A word inside any
occurrence of a window (``window`` consecutive item words, or a whole shorter
item) is hit.

Cases: a null or empty text has no words and is never hit; items without words
or with a null item_id have no windows; item_ids are whole numbers, doc_ids of any
type; repeated items and repeated documents
are treated row by row; extra columns of either input are ignored by
``contamination`` and kept by ``decontaminate``; empty tables give empty
results. An item table of any size works: beyond ``block_words`` words it is cut
into blocks with an automaton each, which are built, broadcast and released one
after the other, and the documents are scanned once for each block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hashloom.llm import textbuf as tb
from hashloom.llm.shared import bounded, texts
from hashloom.sources.scratch import folder

#: Words are runs of these characters once A-Z are lower case.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Words of the shortest run that ``decontaminate`` cuts out.
LEAST_CUT = 5
#: Item words in one automaton: bounds what is broadcast (some tens of MB).
BLOCK_WORDS = 100_000
#: Longer items are cut into overlapping pieces, so that blocks stay even.
PIECE_WORDS = 10_000

#: What the passes over several blocks store, and the names it has while it is beside the columns of the documents.
_HITS = "code string, hit array<long>, items array<long>"
_CODE, _HIT, _ITEMS = (f"decontamination: {x}" for x in ("code", "hit", "items"))
#: For each text of a batch: word count, hit words, item_ids, word starts and ends.
Scan = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, set[int], np.ndarray, np.ndarray]]]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.array([not (c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F) for c in range(256)])


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the windows marked.

    ``pieces``: (item_id, words) pairs. After the build, ``window_at[state]`` is
    the state of the last ``window`` words of any longer match that ends in
    ``state`` (-1: shorter), ``short_at[state]`` lists the states of whole short
    items that are suffixes of it, and ``items[state]`` are the item_ids that
    hold that window.
    """

    def __init__(self, pieces: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window, self.alphabet = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(item, [self.alphabet.setdefault(w, len(self.alphabet)) for w in words]) for item, words in pieces if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._mark(coded)
        self._prefilter([ids for _, ids in coded])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """State for the shorter strings of q, those that end an occurrence of p's longest string and c."""
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _mark(self, coded: list[tuple[int, list[int]]]) -> None:
        n, w = len(self.length), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.window_at = [-1] * n
        for s in order:
            if self.length[s] >= w:
                up = self.link[s]
                self.window_at[s] = s if self.length[up] < w else self.window_at[up]
        whole: set[int] = set()
        gathered: dict[int, set[int]] = {}
        for item, ids in coded:
            s = 0
            for k, c in enumerate(ids):
                s = self.next[s][c]
                if k + 1 >= w:
                    gathered.setdefault(self.window_at[s], set()).add(item)
            if len(ids) < w:
                whole.add(s)
                gathered.setdefault(s, set()).add(item)
        self.short_at: dict[int, tuple[int, ...]] = {0: ()}
        for s in order:
            up = self.short_at[self.link[s]]
            self.short_at[s] = (s, *up) if s in whole else up
        self.short_at = {s: t for s, t in self.short_at.items() if t}
        self.items = {s: frozenset(v) for s, v in gathered.items()}

    def _prefilter(self, coded: list[list[int]]) -> None:
        words = list(self.alphabet)
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(x) for x in words], np.int64)
        low, high = tb.word_keys(tb.words64(tb.padded(raw)), np.cumsum(size) - size, size)
        h = tb.mix(low, high)
        self.hashes, code = np.unique(h, return_inverse=True)  # long words with one key share a code
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True
        code = code.tolist()
        pairs = {code[a] * len(words) + code[b] for ids in coded for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.singles = np.zeros(len(words) + 1, bool)
        sizes = {min(len(ids), self.window) for ids in coded}
        for ids in coded:
            if len(ids) == 1 or self.window == 1:
                self.singles[[code[i] for i in ids]] = True
        self.least = min((n for n in sizes if n > 1), default=0)

    def candidates(self, view: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges that can hold a window; a superset, as long words are told apart later."""
        if not len(start) or not len(self.hashes):
            return []
        h = tb.mix(*tb.word_keys(view, start, size))
        code = np.full(len(start), -1, np.int64)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        known = self.hashes[at] == h[maybe]
        code[maybe[known]] = at[known]
        found: list[tuple[int, int]] = []
        if self.singles.any():
            found += [(i, i + 1) for i in np.flatnonzero(self.singles[code] & (code >= 0)).tolist()]
        if self.least and len(self.pairs):
            left = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (doc[:-1] == doc[1:]))
            pair = code[left] * len(self.alphabet) + code[left + 1]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            linked = np.zeros(len(code), bool)
            linked[left[self.pairs[at] == pair]] = True
            a, b = tb.runs(linked)
            keep = b - a >= self.least - 1
            found += zip(a[keep].tolist(), (b[keep] + 1).tolist())
        return found

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], list[int]]:
        """Hit ranges, item_ids and the longest match length at each word."""
        hits, items, best, state, length, w = [], set(), [], 0, 0, self.window
        moves, links, lengths = self.next, self.link, self.length
        for i, word in enumerate(words):
            c = self.alphabet.get(word, -1)
            while state and c not in moves[state]:
                state = links[state]
                length = lengths[state]
            if c in moves[state]:
                state, length = moves[state][c], length + 1
            else:
                state, length = 0, 0
            best.append(length)
            if length >= w:
                hits.append((i + 1 - w, i + 1))
                items |= self.items[self.window_at[state]]
            for s in self.short_at.get(state, ()):
                if lengths[s] <= length:
                    hits.append((i + 1 - lengths[s], i + 1))
                    items |= self.items[s]
        return hits, items, best


def _bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in lower case (padded), where texts begin, each text's first word, word starts and word ends."""
    raw, off = tb.buffers(column)
    pad = tb.padded(_LOWER[raw])
    inside = _IS_WORD[pad[: len(raw)]]
    cut = off[1:-1]
    # A word never spans two texts: where texts touch, a run is split.
    flags = np.concatenate((inside, [False]))
    starts = flags[:-1].copy()
    starts[1:] &= ~flags[:-2]
    touch = cut[cut < len(raw)]
    starts[touch] |= flags[touch]
    begin = np.flatnonzero(starts)
    ends = flags[:-1] & ~flags[1:]
    touch = cut[cut > 0] - 1
    ends[touch] |= flags[touch]
    return pad, off, np.searchsorted(begin, off), begin, np.flatnonzero(ends) + 1


def _scan(column: pa.Array, automaton: SuffixAutomaton) -> Iterator[tuple[int, np.ndarray, set[int], np.ndarray, np.ndarray]]:
    """For each text: word count, numbers of hit words (sorted), item_ids, word starts and ends in the text's bytes."""
    pad, off, first, begin, end = _bounds(column)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    hit: dict[int, tuple[set[int], set[int]]] = {}
    text = pad.tobytes()
    for a, b in automaton.candidates(tb.words64(pad), begin, end - begin, doc):
        ranges, items, _ = automaton.stream([text[begin[i] : end[i]] for i in range(a, b)])
        if ranges:
            own = hit.setdefault(int(doc[a]), (set(), set()))
            for x, y in ranges:
                own[0].update(range(a + x, a + y))
            own[1].update(items)
    for d in range(len(off) - 1):
        lo, hi = first[d], first[d + 1]
        got, items = hit.get(d, ((), ()))
        numbers = np.array(sorted(got), np.int64) - lo
        yield int(hi - lo), numbers, set(items), begin[lo:hi] - off[d], end[lo:hi] - off[d]


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words as one binary, n): items in pieces of a bounded number of words that overlap by a window less one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = WORD.findall(text.encode("utf-8", "surrogatepass").translate(bytes(_LOWER))) if text else []
                step = max(1, PIECE_WORDS - window + 1)
                for k in range(0, max(1, len(words) - window + 1), step):
                    if part := words[k : k + step + window - 1]:
                        rows.append((item, b" ".join(part), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["item_id", "words", "n"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").mapInArrow(cut, "item_id long, words binary, n long")


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """One automaton for each block of at most ``block_words`` item words (or one piece); the driver holds one block at a time."""
    held, size = [], 0
    for r in _pieces(items, window).distinct().toLocalIterator():
        if held and size + r.n > block_words:
            yield SuffixAutomaton(held, window)
            held, size = [], 0
        held.append((r.item_id, bytes(r.words).split(b" ")))
        size += r.n
    yield SuffixAutomaton(held, window)


def _write_hits(texts: DataFrame, automaton: SuffixAutomaton, path: str) -> None:
    """Add (code, hit, items) of the texts that one block hits; its broadcast is gone afterwards."""
    shared = texts.sparkSession.sparkContext.broadcast(automaton)
    kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                scanned = zip(part.column("code").to_pylist(), _scan(part.column("text"), shared.value))
                rows = [(code, hit.tolist(), sorted(found)) for code, (_, hit, found, _, _) in scanned if len(hit)]
                columns = zip(*rows) if rows else ((),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["code", "hit", "items"])

    texts.mapInArrow(run, _HITS).write.mode("append").parquet(path)
    shared.destroy()


def _joined(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, set[int], np.ndarray, np.ndarray]]:
    """As ``_scan``, from the hits that were joined to the texts."""
    _, off, first, begin, end = _bounds(batch.column("text"))
    hits, items = batch.column(_HIT).to_pylist(), batch.column(_ITEMS).to_pylist()
    for d in range(len(off) - 1):
        lo, hi = first[d], first[d + 1]
        yield int(hi - lo), np.array(sorted(hits[d] or ()), np.int64), set(items[d] or ()), begin[lo:hi] - off[d], end[lo:hi] - off[d]


def _with_hits(docs: DataFrame, items: DataFrame, window: int, block_words: int) -> tuple[DataFrame, Scan]:
    """The documents, and a function that gives for a batch of them what ``_scan`` gives, over all blocks of items.

    A single block is broadcast and scanned in the caller's pass. Of more blocks one
    at a time is built, broadcast, scanned against all documents and released, so
    that memory does not grow with the items; what is hit is stored under the hash
    of the text and joined to the documents.
    """
    spark, blocks = docs.sparkSession, automata(items, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first)
        return docs, lambda batch: _scan(batch.column("text"), shared.value)
    code, path = F.sha2(F.col("text").cast("binary"), 256), folder(spark)
    for automaton in chain((first, second), blocks):
        _write_hits(docs.where("text is not null").select(code.alias("code"), "text"), automaton, path)
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    hits = spark.read.schema(_HITS).parquet(path).groupBy(F.col("code").alias(_CODE)).agg(union("hit").alias(_HIT), union("items").alias(_ITEMS))
    return docs.withColumn(_CODE, code).join(hits, _CODE, "left").drop(_CODE), _joined


def _digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, coverage."""
    docs = texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs, scan = _with_hits(docs, items, window, block_words)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.float64())
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "coverage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                rows = [(n, len(hit), len(found), _digest(found), len(hit) > 0, len(hit) / n if n else 0.0) for n, hit, found, _, _ in scan(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, coverage double")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = LEAST_CUT - 1, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without the passages they share with items; all columns of ``docs`` stay.

    A run of hit words that is longer than ``max_span`` words is cut out of the
    text with what stands between its words: by default every window, and every
    whole item of 5 to 9 words; items of fewer words, which ordinary text may hold
    by chance, only count toward the coverage; a document of which more than
    ``max_coverage`` of the words are hit goes as a whole. n_chars, where there is
    such a column, follows the new text. With several blocks of items, the hit
    words of all blocks are put together before a document is judged and cut.
    """
    schema = docs.schema
    docs, scan = _with_hits(bounded(docs), items, window, block_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                texts, keep = [], []
                whole = part.column("text").to_pylist()
                for text, (n, hit, _, begin, end) in zip(whole, scan(part)):
                    keep.append(not n or len(hit) <= max_coverage * n)
                    if len(hit) and keep[-1]:
                        raw, out, at = text.encode(), [], 0
                        cuts = np.flatnonzero(np.diff(hit) > 1)
                        for a, b in zip(np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(hit) - 1]))):
                            if b - a + 1 > max_span:
                                out.append(raw[at : begin[hit[a]]])
                                at = end[hit[b]]
                        text = b"".join([*out, raw[at:]]).decode()
                    texts.append(text)
                columns = {name: part.column(name) for name in schema.names} | {"text": pa.array(texts, part.schema.field("text").type)}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(cut, schema)
