"""BPE encoding and decoding with contiguous rank arrays.

Words are merged side by side: a row of an array holds a word's parts, a second
one the merge ranks of neighbouring parts. Each round finds every row's least
rank, joins those two parts, closes the gap and looks up the two ranks beside
it; a row is done when no pair has a rank. Words of more than ``SHORT_WORD``
bytes take the same steps alone, with the ranks in a heap, which keeps the time
in proportion to n log n. What a word was encoded as is remembered in a store of
bounded size. Decoding joins the tokens of the ids.

The vocabulary file is read where the work runs; its path is a parameter.

Cases: a null text counts as empty and has no tokens; strings of special tokens
in a text become those tokens, as by default in the tokenizers library; extra
columns are ignored by ``encode`` and kept by ``add_tokens``; a vocabulary file
whose parts ask for other work than this is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from hashloom.llm import pretokens as pt, textbuf as tb
from hashloom.llm.shared import bounded, texts

#: Words of up to so many bytes are merged side by side.
SHORT_WORD = 48
#: Words in the store before it is emptied.
STORE_WORDS = 1 << 19
_NONE = np.int64(1 << 40)
#: The parts of a vocabulary file that this module does the work of (fixed values).
_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
        ],
    },
    "decoder": None,
    "model": {"type": "BPE", "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False},
}
_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a lower-casing BPE vocabulary with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pt.check_parts(spec, _PARTS, _ADDED)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.plain = np.array([vocab[c] for c in letters])
        self.last = np.array([vocab[c + suffix] for c in letters])
        size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [(vocab[a] * size + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, spec["model"]["merges"]))]
        keys = np.array([p[0] for p in pairs], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.ranks = np.array([p[1] for p in pairs], np.int64)[order]
        self.made = np.array([p[2] for p in pairs], np.int64)  # by rank
        self.table = {k: r for k, r, _ in pairs}
        names = [b""] * size
        for token, i in (vocab | self.special).items():
            names[i] = token.encode() + b" "
        self.name_size = np.array([len(x) for x in names], np.int64)
        self.name_at = np.cumsum(self.name_size) - self.name_size
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.transducer = pt.Transducer(pt.unspaced)
        self._reset()

    def _reset(self) -> None:
        self.cache = tb.WordCache()
        self.long: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(1 << 18, np.int64)  # of each stored word, in ids
        self.count = np.zeros(1 << 18, np.int32)
        self.used, self.words = 0, 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _alone(self, word: bytes) -> list[int]:
        part = [int(self.plain[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        n, table, size = len(part), self.table, self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := table.get(part[i] * size + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or table.get(part[i] * size + part[j]) != r:
                continue
            part[i], part[j] = int(self.made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if 0 <= a and b < n and (r := table.get(part[a] * size + part[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in part if p >= 0]

    def _together(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one behind the other, and how many each has. The words have 48 bytes at most, and similar lengths."""
        n, width = len(begin), int(size.max())
        column = np.arange(width)
        bytes_ = raw[np.minimum(begin[:, None] + column, len(raw) - 1)]
        part = self.plain[bytes_]
        row = np.arange(n)
        part[row, size - 1] = self.last[bytes_[row, size - 1]]
        left = size.astype(np.int64).copy()
        inner = column[None, :-1] < left[:, None] - 1
        rank = np.full((n, width), _NONE)
        rank[:, :-1][inner] = self._rank(part[:, :-1][inner], part[:, 1:][inner])
        live = row
        while len(live):
            ranks = rank[live]
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(live)), at]
            live, at, least = live[least < _NONE], at[least < _NONE], least[least < _NONE]
            if not len(live):
                break
            parts, ranks = part[live], rank[live]
            k = np.arange(len(live))
            gap = column[None, :-1] > at[:, None]
            parts[:, :-1] = np.where(gap, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(column[None, :-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            parts[k, at] = self.made[least]
            left[live] -= 1
            right = at + 1 < left[live]
            ranks[k[right], at[right]] = self._rank(parts[k[right], at[right]], parts[k[right], at[right] + 1])
            ranks[k[~right], at[~right]] = _NONE
            before = at > 0
            ranks[k[before], at[before] - 1] = self._rank(parts[k[before], at[before] - 1], parts[k[before], at[before]])
            part[live], rank[live] = parts, ranks
        return part[column[None, :] < left[:, None]].astype(np.int32), left

    def _store(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Numbers of newly stored words."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.words + len(count) > len(self.at):
            self.at, self.count = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.count, np.zeros_like(self.count)))
        number = np.arange(self.words, self.words + len(count))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[number] = self.used + np.cumsum(count) - count
        self.count[number] = count
        self.used, self.words = self.used + len(ids), self.words + len(count)
        return number

    def _numbers(self, raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The stored word of each pre-token."""
        if self.words > STORE_WORDS:
            self._reset()
        pad = tb.padded(np.frombuffer(raw, np.uint8), 64)
        low, high = tb.word_keys(tb.words64(pad), begin, size)
        h = tb.mix(low, high)
        number, known = self.cache.find(low, high, h)
        brief = size <= tb.KEY_BYTES
        todo = np.flatnonzero(~known & brief)
        if len(todo):
            first, back = tb.distinct(low[todo], high[todo], h[todo])
            own = todo[first]
            fresh = np.empty(len(own), np.int64)
            for top in (5, 8, 11, tb.KEY_BYTES):  # similar lengths together: rows are as wide as the longest
                pick = np.flatnonzero((size[own] <= top) & (size[own] > {5: 0, 8: 5, 11: 8}.get(top, 11)))
                for some in np.array_split(pick, max(1, len(pick) // 20_000)):
                    if len(some):
                        fresh[some] = self._store(*self._together(pad, begin[own[some]], size[own[some]]))
            number[todo] = fresh[back]
            self.cache.put(low[own], high[own], h[own], fresh)
        for i in np.flatnonzero(~brief).tolist():
            word = raw[begin[i] : begin[i] + size[i]]
            if (n := self.long.get(word)) is None:
                if len(word) <= SHORT_WORD:
                    ids, count = self._together(pad, begin[i : i + 1], size[i : i + 1])
                else:
                    ids = np.array(self._alone(word), np.int32)
                    count = np.array([len(ids)])
                n = int(self._store(ids, count)[0])
                if len(word) <= 4 * SHORT_WORD:
                    self.long[word] = n
            number[i] = n
        return number

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and the bounds of each text in them."""
        pieces, first, marks = pt.segments(texts, self.special)
        raw, begin, end, kind, piece = pt.split([_normal(p) for p in pieces], self.transducer)
        keep = (kind != pt.SPACE) & (kind != pt.WHITE)
        begin, end, piece = begin[keep], end[keep], piece[keep]
        number = self._numbers(raw, begin, end - begin)
        count = self.count[number].astype(np.int64)
        ids = tb.gather(self.ids, self.at[number], count)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(piece, count, minlength=len(pieces)).astype(np.int64))))
        for shift, (p, _, token) in enumerate(marks):
            ids = np.insert(ids, bounds[p] + shift, token)
        per_text = bounds[first]
        if marks:
            per_text = per_text + np.searchsorted(np.array([d for _, d, _ in marks]), np.arange(len(first)))
        return ids.astype(np.uint32), per_text

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: its tokens with a space between two."""
        size = self.name_size[ids]
        flat = tb.gather(self.names, self.name_at[ids], size).tobytes()
        at = np.concatenate(([0], np.cumsum(size)))[bounds]
        return [flat[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # sigma is lower-cased without regard to its place


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One codec a worker process."""
    return WordBpe(path)


def _texts(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in tb.slices(batch):
                ids, bounds = bpe.encode(_texts(part.column("text")))
                flat = ids.astype("<u4").tobytes()
                own = [flat[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                sha = [hashlib.sha256(x).hexdigest() for x in own]
                decoded = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, bounds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(own, pa.binary()), pa.array(sha), pa.array(decoded)], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode``, without the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in tb.slices(batch):
                ids, bounds = bpe.encode(_texts(part.column("text")))
                flat = ids.astype("<u4").tobytes()
                sha = [hashlib.sha256(flat[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                decoded = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, bounds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sha), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def add_tokens(docs: DataFrame, path: str) -> DataFrame:
    """The documents with ids (array<int>) and n_tokens; other columns stay (columns of these names are replaced)."""
    docs = docs.drop("ids", "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in tb.slices(batch):
                ids, bounds = bpe.encode(_texts(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds)), lists], names=[*part.schema.names, "n_tokens", "ids"])

    return bounded(docs).mapInArrow(run, schema)
