"""Token counts from compiled finite-state transducers.

Two deterministic transducers work one behind the other. The first splits text
into pre-tokens; chunks of text are run in lockstep and their state maps are
composed by a parallel prefix scan (see ``pretokens``). The second reads a
pre-token's bytes: its transitions carry the change of the token count, so that
the sum along the path is the number of tokens. Its states are what the rest of
a pre-token can depend on: the longest suffix read so far that begins some
vocabulary token, and, for each place in that suffix, the last token of the text
up to there and its count relative to now. They are compiled when first
reached, and the compiled part is dropped when it reaches ``MAX_STATES``.

A pre-token of more than ``LONG`` bytes is cut into chunks. A chunk's state map
gives, for the states it may be entered in, the state at its end and the count of
tokens emitted on the way; the maps, which differ only in what the chunks hold,
are composed by a parallel prefix scan. A chunk's map begins with one state, found
by reading the ``WARM`` bytes before the chunk (what stands further back is mostly
forgotten); where the scan shows that a chunk is entered in another state, its map
gets that state too and the scan is repeated.

Why this gives the merge procedure's result: the tokens of a text up to a token
boundary are the tokens of that text alone, and a token can follow another just
when the two, put together, are tokenized into the two. So exactly one
vocabulary token can end at each place.

Cases: a vocabulary file whose parts ask for other work than this is an error; a
null text counts as empty, with 0 bytes and tokens; strings of special
tokens are one token each, as by default in the tokenizers library; extra
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hashloom.llm import pretokens as pt, textbuf as tb
from hashloom.llm.bpe_codec import byte_letters
from hashloom.llm.shared import texts

#: Compiled states, and remembered token pairs, before they are dropped.
MAX_STATES = 300_000
#: Bytes of a pre-token beyond which it is read in chunks, bytes of a chunk, and bytes read before one.
LONG, CHUNK, WARM = 512, 256, 64
#: The parts of a vocabulary file that this module does the work of (fixed values).
_PARTS = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}
_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
_SHIFT, _HALF = 24, 1 << 23  # of a packed count
_START = (b"", ((-1, 0),))


def scan(maps: list[dict[int, tuple[int, int]]]) -> list[dict[int, tuple[int, int]]]:
    """Inclusive prefix scan of state maps: item k takes a state before the first chunk to the state and count behind chunk k, where all maps between know their states."""
    width = 1
    while width < len(maps):
        maps = maps[:width] + [
            {s: (own[to][0], n + own[to][1]) for s, (to, n) in before.items() if to in own} for before, own in zip(maps, maps[width:])
        ]
        width *= 2
    return maps


class CountingTransducer:
    """Counts the tokens of byte-level BPE pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pt.check_parts(spec, _PARTS, _ADDED)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        names = {token: bytes(map(byte_of.__getitem__, token)) for token in spec["model"]["vocab"]}
        self.vocab = {names[t]: i for t, i in spec["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.vocab.items()}
        self.ranks = {(names[a], names[b]): r for r, (a, b) in enumerate(map(tuple, spec["model"]["merges"]))}
        self.prefixes = {b[:k] for b in self.vocab for k in range(len(b))}
        self.splitter = pt.Transducer(pt.spaced)
        self.cache = tb.WordCache()
        self.long: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.states, self.number = [_START], {_START: 0}
        self.moves: dict[int, int] = {}  # state << 8 | byte: next state << _SHIFT | change + _HALF
        self.pairs: dict[int, bool] = {}  # left << 20 | right
        self.ends: dict[tuple[int, int], tuple[int, int]] = {}  # one object for equal (token, count)

    def _follows(self, left: int, right: int) -> bool:
        """Whether the two tokens' text is tokenized into just these two."""
        if (known := self.pairs.get(left << 20 | right)) is None:
            a, b = self.bytes[left], self.bytes[right]
            part = [(a + b)[k : k + 1] for k in range(len(a) + len(b))]
            while len(part) > 1:
                rank, k = min((self.ranks.get((part[k], part[k + 1]), 1 << 40), k) for k in range(len(part) - 1))
                if rank == 1 << 40:
                    break
                part[k : k + 2] = [part[k] + part[k + 1]]
            known = self.pairs[left << 20 | right] = part == [a, b]
        return known

    def _end(self, token: int, count: int) -> tuple[int, int]:
        own = (token, count)
        return self.ends.setdefault(own, own)

    def _compile(self, state: int, byte: int) -> int:
        """Where a byte leads to, and the change of the count."""
        suffix, ends = self.states[state]
        text = suffix + bytes((byte,))
        for k in range(len(text)):
            token = self.vocab.get(text[k:])
            if token is not None:
                last, count = ends[k]
                if last < 0 or self._follows(last, token):
                    break
        else:
            raise AssertionError("a single byte is always a token that can follow")
        change = count + 1
        k = next(k for k in range(len(text) + 1) if text[k:] in self.prefixes)
        # A place that no vocabulary token can reach from any more says nothing about the rest.
        to = (text[k:], tuple(self._end(ends[i][0], ends[i][1] - change) if text[i:] in self.prefixes else None for i in range(k, len(text))) + (self._end(token, 0),))
        number = self.number.get(to)
        if number is None:
            number = self.number[to] = len(self.states)
            self.states.append(to)
        if not -_HALF <= change < _HALF:
            raise OverflowError(f"a transition changes the count by {change}")
        move = self.moves[state << 8 | byte] = number << _SHIFT | change + _HALF
        return move

    def _read(self, state: int, data: bytes) -> tuple[int, int]:
        """The state behind the bytes, and the change of the count."""
        count, moves = 0, self.moves
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._compile(state, byte)
            state = move >> _SHIFT
            count += (move & 2 * _HALF - 1) - _HALF
        return state, count

    def _chunked(self, word: bytes) -> int:
        """The number of tokens of a long pre-token, from its chunks' state maps."""
        starts = range(0, len(word), CHUNK)
        maps: list[dict[int, tuple[int, int]]] = []
        for at in starts:
            enter = self._read(0, word[max(0, at - WARM) : at])[0]
            maps.append({enter: self._read(enter, word[at : at + CHUNK])})
        while True:
            upto = scan(maps)
            k = next((k for k, m in enumerate(upto) if 0 not in m), None)
            if k is None:
                return upto[-1][0][1]
            enter = upto[k - 1][0][0]
            while k < len(maps) and enter not in maps[k]:
                maps[k][enter] = self._read(enter, word[starts[k] : starts[k] + CHUNK])
                enter = maps[k][enter][0]
                k += 1

    def tokens(self, word: bytes) -> int:
        """The number of tokens of one pre-token."""
        if len(self.states) > MAX_STATES or len(self.pairs) > 4 * MAX_STATES:
            self._reset()
        return self._read(0, word)[1] if len(word) <= LONG else self._chunked(word)

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        pieces, first, marks = pt.segments(texts, self.special)
        raw, begin, end, _, piece = pt.split(pieces, self.splitter)
        size = end - begin
        low, high = tb.word_keys(tb.words64(tb.padded(np.frombuffer(raw, np.uint8))), begin, size)
        h = tb.mix(low, high)
        value, known = self.cache.find(low, high, h)
        value = value.astype(np.int64)
        brief = size <= tb.KEY_BYTES
        todo = np.flatnonzero(~known & brief)
        if len(todo):
            at, back = tb.distinct(low[todo], high[todo], h[todo])
            own = todo[at]
            fresh = np.fromiter((self.tokens(raw[a:b]) for a, b in zip(begin[own].tolist(), end[own].tolist())), np.int64, len(own))
            value[todo] = fresh[back]
            self.cache.put(low[own], high[own], h[own], fresh)
        if len(self.long) > 200_000:
            self.long.clear()
        for i in np.flatnonzero(~brief).tolist():
            word = raw[begin[i] : end[i]]
            if (n := self.long.get(word)) is None:
                n = self.tokens(word)
                if len(word) <= 64:
                    self.long[word] = n
            value[i] = n
        bounds = np.concatenate(([0], np.cumsum(np.bincount(piece, value, minlength=len(pieces)).astype(np.int64))))
        total = np.diff(bounds[first])
        if marks:
            total += np.bincount([d for _, d, _ in marks], minlength=len(texts))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> CountingTransducer:
    """One transducer a worker process; what it has compiled serves all its tasks."""
    return CountingTransducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = counter(path)
        for batch in batches:
            for part in tb.slices(batch):
                n = fst.count(part.column("text").fill_null("").to_pylist())
                _, off = tb.buffers(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
