"""Counts of what texts and lines are made of, by numpy over the UTF-8 bytes of an Arrow column.

All of a text is counted.  Word equality is that of 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import mix, text_buffer, word_hashes

#: Byte classes.
SPACE, NEWLINE, UPPER, LOWER, DIGIT, SYMBOL, PIPE, BANG, STOP, OTHER, LEAD, CONTINUATION = range(12)
CLASSES = 12
CHUNK = 1 << 18

_CLASS = np.full(256, OTHER, dtype=np.int64)
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
_CLASS[0x0A] = NEWLINE
_CLASS[65:91] = UPPER
_CLASS[97:123] = LOWER
_CLASS[48:58] = DIGIT
_CLASS[[ord(c) for c in "#*$%&<>"]] = SYMBOL
_CLASS[ord("|")] = PIPE
_CLASS[ord("!")] = BANG
_CLASS[[ord(c) for c in ".,;:?"]] = STOP
_CLASS[0xC0:] = LEAD
_CLASS[0x80:0xC0] = CONTINUATION


def count_classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(segments, CLASSES): the bytes of each class in each segment; segments may be empty."""
    out = np.zeros(len(starts) * CLASSES, dtype=np.int64)
    for a in range(0, len(raw), CHUNK):
        b = min(len(raw), a + CHUNK)
        # The segments of this stretch, and how much of it each has.
        first, last = np.searchsorted(starts, [a, b - 1], side="right") - 1
        edges = np.append(np.maximum(starts[first : last + 1], a), b)
        owner = np.repeat(np.arange(last + 1 - first), np.diff(edges))
        counts = np.bincount(owner * CLASSES + _CLASS[raw[a:b]], minlength=(last + 1 - first) * CLASSES)
        out[first * CLASSES : (last + 1) * CLASSES] += counts
    return out.reshape(-1, CLASSES)


@dataclass
class Texts:
    """What each text of a column has; lines are those between newlines."""

    raw: np.ndarray
    at: np.ndarray
    counts: np.ndarray  # (texts, CLASSES)
    words: np.ndarray  # hash of each word, case kept
    word_at: np.ndarray
    word_line: np.ndarray  # the line of each word
    line_start: np.ndarray  # byte
    line_at: np.ndarray  # first line of each text, and the total
    line_counts: np.ndarray
    line_words: np.ndarray  # words in each line
    line_echo: np.ndarray  # words equal to the word before them, in each line
    line_seen: np.ndarray  # an earlier line of the text is equal, and has a word
    repeated: np.ndarray  # words of each text in three-word windows found twice or more
    distinct: np.ndarray  # distinct words


def read(column: pa.Array) -> Texts:
    raw, at = text_buffer(column)
    n = len(at) - 1
    breaks = np.flatnonzero(raw == 0x0A) + 1
    # A text with k newlines has k + 1 lines, the empty text one.
    line_start = np.sort(np.concatenate([at[:-1], breaks]), kind="stable")
    owner = np.concatenate([np.arange(n), np.searchsorted(at, breaks - 1, side="right") - 1])
    line_at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)
    line_counts = count_classes(raw, line_start)
    has = np.flatnonzero(np.diff(line_at))
    counts = np.zeros((n, CLASSES), dtype=np.int64)
    if n:
        counts[has] = np.add.reduceat(line_counts, line_at[:-1][has], axis=0)
    words, word_at = word_hashes(column, fold=False)
    word_line, line_echo = _words_by_line(raw, line_start, at, words)
    line_words = np.bincount(word_line, minlength=len(line_start))
    seen = np.zeros(len(line_start), dtype=bool)
    repeated, distinct = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    ends = np.append(line_start[1:], len(raw))
    for i in range(n):
        w = words[word_at[i] : word_at[i + 1]]
        if len(w):
            distinct[i] = len(np.unique(w))
        if len(w) > 3 and distinct[i] < len(w):
            three = mix(mix(mix(w[:-2]) + w[1:-1]) + w[2:])
            order = np.argsort(three, kind="stable")
            same = three[order[1:]] == three[order[:-1]]
            twice = np.zeros(len(three), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(w), dtype=bool)
            for k in range(3):
                cover[k : k + len(three)] |= twice
            repeated[i] = cover.sum()
        a, b = line_at[i], line_at[i + 1]
        if b - a > 1:
            # raw[...] ends with its newline but in the last line
            before: set[bytes] = set()
            for j in range(a, b):
                if line_words[j]:
                    line = raw[line_start[j] : ends[j] - (j < b - 1)].tobytes()
                    if line in before:
                        seen[j] = True
                    before.add(line)
    return Texts(raw, at, counts, words, word_at, word_line, line_start, line_at, line_counts, line_words, line_echo, seen, repeated, distinct)


def _words_by_line(raw: np.ndarray, line_start: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line of each word, words of each line that are equal to the word before them)"""
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(len(line_start), dtype=np.int64)
    inside = _CLASS[raw] > NEWLINE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_text = at[:-1][np.diff(at) > 0]
    first[starts_of_text] = inside[starts_of_text]
    owner = np.searchsorted(line_start, np.flatnonzero(first), side="right") - 1
    echo = np.zeros(len(words), dtype=bool)
    echo[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    return owner, np.bincount(owner, weights=echo, minlength=len(line_start)).astype(np.int64)
