"""Numpy views over Arrow text columns, shared by the text operators.

Nothing here knows about Spark: the functions turn a slice of an Arrow string
column into byte arrays, word boundaries and fixed-width word keys, so that the
operators' ``mapInArrow`` bodies can work on a few megabytes of text at a time
with array operations instead of a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled by one round of array operations.
SLICE_BYTES = 1 << 20
#: Words of up to so many bytes have exact 128-bit keys.
KEY_BYTES = 15
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def padded(raw: np.ndarray, extra: int = 32) -> np.ndarray:
    """A copy with zero bytes behind it, for reads past the end."""
    out = np.zeros(len(raw) + extra, np.uint8)
    out[: len(raw)] = raw
    return out


def words64(pad: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one little-endian integer."""
    return np.ndarray(shape=(len(pad) - 7,), dtype="<u8", buffer=pad, strides=(1,))


def word_keys(view: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers a word; equal for equal words, and only for those if a word has at most KEY_BYTES bytes."""
    low = view[start] & _MASK[np.minimum(size, 8)]
    high = view[start + 8] & _MASK[np.clip(size - 8, 0, 7)]
    return low, high | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))


def mix(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One well-spread 64-bit hash of two integers."""
    h = low * _MIX[0]
    h ^= h >> np.uint64(29)
    h += high
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def word_hashes(view: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of all bytes of each word, whatever its length."""
    h = mix(*word_keys(view, start, size))
    long = np.flatnonzero(size > KEY_BYTES)
    at = KEY_BYTES
    while len(long):
        h[long] = mix(h[long], view[start[long] + at] & _MASK[np.minimum(size[long] - at, 8)])
        at += 8
        long = long[size[long] > at]
    return h


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + size], one behind the other."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    at = np.cumsum(size) - size
    return flat[np.repeat(start - at, size) + np.arange(total)]


class WordCache:
    """Direct-mapped store of one integer a word, for words of up to KEY_BYTES bytes.

    A slot holds the last word put there, so memory is fixed; a word that has
    been pushed out is worked out again.
    """

    def __init__(self, bits: int = 19):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.low, self.high, self.value = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32)

    def find(self, low: np.ndarray, high: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which of them are known. No word has high == 0."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.intp)
        return self.value[slot], (self.low[slot] == low) & (self.high[slot] == high)

    def put(self, low: np.ndarray, high: np.ndarray, h: np.ndarray, value: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.intp)
        _, last = np.unique(slot[::-1], return_index=True)  # one writer a slot, so that key and value agree
        pick = len(slot) - 1 - last
        slot = slot[pick]
        self.low[slot], self.high[slot], self.value[slot] = low[pick], high[pick], value[pick]


def distinct(low: np.ndarray, high: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one row of each distinct key, and for each row its place among those."""
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    if np.array_equal(low[first][back], low) and np.array_equal(high[first][back], high):
        return first, back
    order = np.lexsort((low, high))  # two words share a hash: compare the keys themselves
    new = np.concatenate(([True], (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)))
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back
