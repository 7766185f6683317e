"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of characters other than ``\\x20 \\x09-\\x0D``; A-Z is
lower-cased, nothing else is folded.  All separators are single ASCII bytes,
so the work is done on the UTF-8 bytes of a column without making Python
strings.  Hashes are 64 bits wide.  Memory is bounded by ``CHUNK`` bytes of
working arrays plus eight bytes per word of the texts given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
SHINGLE = 5

_U = np.uint64
np.seterr(over="ignore")  # hashes are meant to wrap
_ROOT = 0x9E3779B97F4A7C15 | 1
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64) + _U(1)
_FOLD[65:91] += _U(32)
_EXACT = np.arange(256, dtype=np.uint64) + _U(1)
_SPREAD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def run(base: int) -> np.ndarray:
                out = np.full(n, _U(base))
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = run(_ROOT), run(pow(_ROOT, -1, 1 << 64))
        return self.up, self.down


_POWERS = _Powers()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each row and the total)."""
    raw, at = text_buffer(column)
    if not len(raw):
        return np.empty(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[at] = True
    table = _FOLD if fold else _EXACT
    hashes, starts, a = [], [], 0
    while a < len(raw):
        b = min(len(raw), a + CHUNK)
        if b < len(raw):  # cut where no word is cut
            cuts = np.flatnonzero(_SEPARATOR[raw[a:b]] | first[a:b])
            cut = a + int(cuts[-1]) if len(cuts) else a
            if cut <= a:
                step = b
                while True:
                    upto = min(step + CHUNK, len(raw))
                    more = np.flatnonzero(_SEPARATOR[raw[step:upto]] | first[step:upto])
                    if len(more):
                        cut = step + int(more[0])
                        break
                    step += CHUNK
                    if step >= len(raw):
                        cut = len(raw)
                        break
            b = cut
        piece = raw[a:b]
        inside = ~_SEPARATOR[piece]
        edge = first[a:b]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        s = np.flatnonzero(inside & (~before | edge))
        if len(s):
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            stop = np.empty_like(inside)
            stop[-1] = True
            stop[:-1] = edge[1:]
            e = np.flatnonzero(inside & (~after | stop)) + 1
            up, down = _POWERS.get(max(CHUNK, len(piece)))
            run = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(table[piece] * up[: len(piece)], out=run[1:])
            hashes.append(mix((run[e] - run[s]) * down[s]))
            starts.append(s + a)
        a = b
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the windows of one text's words; a shorter text is one window."""
    n = len(words)
    if not n:
        return words
    if n < size:
        value = np.full(1, n, dtype=np.uint64)
        for k in range(n):
            value = mix(value + words[k] * _SPREAD[k])
        return value
    value = words[: n - size + 1] * _SPREAD[0]
    for k in range(1, size):
        value = value + words[k : n - size + 1 + k] * _SPREAD[k]
    return np.unique(mix(value))
