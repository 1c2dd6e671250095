"""Pre-token boundaries by a small deterministic transducer over character classes.

A text is a row of character classes. Chunks of it are run in lockstep: each
chunk first gives its state map (the end state for every start state), the maps
are composed by a parallel prefix scan, and a second round, which then knows
every chunk's start state, collects the outputs. An output says whether a
pre-token starts at this character, at the one before, or at both.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import regex

END, SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, SHORT, R, V, L, E = range(12)
N_CLASSES = 12
CHUNK = 128
_HEAD = 8


@cache
def char_classes() -> np.ndarray:
    """The class of every code point; s, t, m, d, r, v, l, e can be part of an English contraction."""
    out = np.full(0x110000, OTHER, np.uint8)
    for block in range(0, 0x110000, 0x1000):
        if 0xD800 <= block < 0xE000:
            continue
        chars = "".join(map(chr, range(block, block + 0x1000)))
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
            for m in regex.finditer(pattern, chars):
                out[block + m.start()] = kind
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in chars:
            out[ord(c)] = kind
    return out


class Transducer:
    """States and outputs as tables; states are kept times N_CLASSES, so that state + class is a table index."""

    def __init__(self, step: Callable[[str, int], tuple[str, int]]):
        names, table = ["start"], []
        for name in names:
            for c in range(N_CLASSES):
                to, out = step(name, c)
                if to not in names:
                    names.append(to)
                table.append((names.index(to), out))
        self.n = len(names)
        self.next = np.array([to * N_CLASSES for to, _ in table], np.uint8)
        self.out = np.array([o for _, o in table], np.uint8)

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Marks the characters that pre-tokens start at; ``classes`` ends with END."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, END, np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        state = self._enter(grid, chunks)
        out = np.empty_like(grid)
        for j in range(CHUNK):
            at = state + grid[j]
            out[j] = self.out[at]
            state = self.next[at]
        flat = np.ascontiguousarray(out.T).reshape(-1)[:n]
        begin = (flat & 1).astype(bool)
        begin[:-1] |= (flat[1:] & 2).astype(bool)
        return begin

    def _enter(self, grid: np.ndarray, chunks: int) -> np.ndarray:
        """The state in which each chunk is entered, the first one in ``start``."""
        maps = np.repeat((np.arange(self.n, dtype=np.uint8) * N_CLASSES)[:, None], chunks, axis=1)
        for j in range(_HEAD):
            maps = self.next[maps + grid[j]]
        apart = np.flatnonzero((maps != maps[0]).any(axis=0))  # few: most chunks soon forget where they began
        one, wide = maps[0].copy(), maps[:, apart]
        for j in range(_HEAD, CHUNK):
            one = self.next[one + grid[j]]
        if len(apart):
            rest = np.ascontiguousarray(grid[:, apart])
            for j in range(_HEAD, CHUNK):
                wide = self.next[wide + rest[j]]
        maps = np.repeat(one[None, :], self.n, axis=0)
        maps[:, apart] = wide
        maps //= N_CLASSES
        width = 1
        while width < chunks:  # inclusive scan: maps[:, i] becomes the map of the chunks up to i
            maps[:, width:] = np.take_along_axis(maps[:, width:], maps[:, :-width].astype(np.intp), axis=0)
            width *= 2
        enter = np.zeros(chunks, np.uint8)
        enter[1:] = maps[0, :-1] * N_CLASSES
        return enter


_RUN = {LETTER: "letters", SHORT: "letters", R: "letters", V: "letters", L: "letters", E: "letters", NUMBER: "numbers", OTHER: "others", QUOTE: "quote"}
_TAILS = {("quote", SHORT): "start", ("quote", R): "quote r", ("quote", V): "quote v", ("quote", L): "quote l", ("quote r", E): "start", ("quote v", E): "start", ("quote l", L): "start"}


def _quote(state: str, c: int, fresh: Callable[[int], tuple[str, int]], run: dict[int, str]) -> tuple[str, int]:
    """After an apostrophe that a pre-token starts at: a contraction, or a run of other characters."""
    if (state, c) in _TAILS:
        return _TAILS[state, c], 0
    if state == "quote":
        return ("others", 0) if run.get(c) in ("others", "quote") else fresh(c)
    to, out = ("letters", 0) if run.get(c) == "letters" else fresh(c)
    return to, out | 2


def spaced(state: str, c: int) -> tuple[str, int]:
    """Contractions, runs of letters, numbers or others with one space before them, and white space (a run leaves its last character to what follows)."""

    def fresh(c: int) -> tuple[str, int]:
        return _RUN.get(c) or {SPACE: "space", WHITE: "white"}.get(c, "start"), 1

    if state.startswith("quote"):
        return _quote(state, c, fresh, _RUN)
    own = "others" if c == QUOTE else _RUN.get(c)
    if state == own:
        return state, 0
    if state in ("space", "white", "run space", "run white"):
        if c in (SPACE, WHITE):
            return "run space" if c == SPACE else "run white", 0
        if c == END or state == "white":
            return fresh(c)
        if state == "run white":
            to, out = fresh(c)
            return to, out | 2
        return own, 2 * (state == "run space")
    return fresh(c)


def unspaced(state: str, c: int) -> tuple[str, int]:
    """Contractions, runs of letters or others, single numbers; white space belongs to no pre-token and starts at each character."""

    def fresh(c: int) -> tuple[str, int]:
        return _RUN.get(c, "start"), 1

    if state.startswith("quote"):
        return _quote(state, c, fresh, _RUN)
    if state != "numbers" and state == ("others" if c == QUOTE else _RUN.get(c)):
        return state, 0
    return fresh(c)


def check_parts(spec: dict, parts: dict, added: dict) -> None:
    """Raise where a vocabulary file asks for another normaliser, splitter or model than the given parts, or for special tokens of another kind."""

    def differs(want: object, got: object) -> bool:
        if isinstance(want, dict):
            return not isinstance(got, dict) or any(differs(v, got.get(k)) for k, v in want.items())
        if isinstance(want, list):
            return not isinstance(got, list) or len(want) != len(got) or any(map(differs, want, got))
        return want != got

    for name, want in parts.items():
        if differs(want, spec.get(name)):
            raise ValueError(f"the vocabulary file has another {name}: {str({k: v for k, v in (spec.get(name) or {}).items() if k not in ('vocab', 'merges')})[:300]}")
    if other := [t["content"] for t in spec["added_tokens"] if differs(added, t)]:
        raise ValueError(f"added tokens of another kind: {other[:5]}")


def segments(texts: list[str], special: dict[str, int]) -> tuple[list[str], np.ndarray, list[tuple[int, int, int]]]:
    """Texts cut at special tokens: pieces, the number of pieces before each text, and (piece, text, id) of each special token, which stands before that piece."""
    if not special:
        return texts, np.arange(len(texts) + 1), []
    pattern = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
    lead = [s[:2] for s in special]
    pieces, first, marks = [], [0], []
    for d, text in enumerate(texts):
        if any(x in text for x in lead) and (found := list(pattern.finditer(text))):
            at = 0
            for m in found:
                pieces.append(text[at : m.start()])
                marks.append((len(pieces), d, special[m[0]]))
                at = m.end()
            text = text[at:]
        pieces.append(text)
        first.append(len(pieces))
    return pieces, np.array(first), marks


def split(pieces: list[str], transducer: Transducer) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of the pieces with a zero byte behind each; byte starts and ends, class of the first character, and piece of each pre-token."""
    text = "\0".join([*pieces, ""])
    raw = text.encode("utf-8", "surrogatepass")
    stops = np.cumsum([len(p) + 1 for p in pieces]) - 1
    if len(raw) == len(text):
        points, at = np.frombuffer(raw, np.uint8), None
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.cumsum(width) - width
    classes = char_classes()[points]
    classes[stops] = END
    begin = np.flatnonzero(transducer.starts(classes))
    end = np.append(begin[1:], len(classes))
    kind = classes[begin]
    keep = kind != END
    begin, end, kind = begin[keep], end[keep], kind[keep]
    piece = np.searchsorted(stops, begin)
    if at is not None:
        begin, end = at[begin], np.append(at, len(raw))[end]
    return raw, begin, end, kind, piece
