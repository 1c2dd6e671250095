"""Word boundaries and word shingles of Arrow text columns.

Words are runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII
characters; the shingles of a text are the hashes of its runs of ``width``
words, or of all its words where it has fewer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from hashloom.llm import textbuf as tb

WIDTH = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.array([chr(c).isalnum() or c >= 0x80 for c in range(256)])


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with zeros behind; word starts and ends; bounds of each text's words."""
    raw, off = tb.buffers(column)
    pad = tb.padded(_LOWER[raw])
    inside = _IS_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[off] = True
    begin = np.flatnonzero(edge)
    end = begin[1:]
    begin = begin[:-1]
    keep = inside[begin] if len(begin) else np.zeros(0, bool)
    begin, end = begin[keep], end[keep]
    return pad, begin, end, np.searchsorted(begin, off)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    pad, begin, end, bounds = spans(column)
    h = tb.word_hashes(tb.words64(pad), begin, end - begin)
    rolled = h
    for k in range(1, width):
        rolled = tb.mix(rolled[:-1], h[k:] + np.uint64(k)) if len(rolled) > 1 else rolled[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = h[a : a + 1]
            for k in range(a + 1, b):
                short = tb.mix(short, h[k : k + 1] + np.uint64(k - a))
            out.append(tb.mix(short, np.full(1, b - a, np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
