"""Chroma audio fingerprints and their alignment.

A recording becomes frames of twelve pitch-class energies.  Sixteen filters,
differences of sums over rectangles of sixteen frames that an integral image
gives in a few additions, are quantised to two bits each (Gray-coded) and
packed into one 32-bit integer a frame.

Recordings with equal codes are one class.  A search takes some recordings as
queries against one of each class.  Queries are packed to blocks, and classes to
chunks, of about ``BLOCK_BYTES`` of codes, or one longer recording; a join on the
block's number brings each chunk to each block, so nothing passes through the
driver and classes are read once for any number of queries.  Codes that differ
in at most one bit vote for an offset, and every offset that has a vote is
judged by the share of wrong bits over the overlap.  All votes count; none is
dropped for being frequent.

Defined results: null, empty and too short recordings have no codes, are a
class each of their own and match nothing; a class's key is its least; ties
of offsets go to the most overlap, then the least offset; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spread import spread
from .shared import Workspace, total_bytes

RATE = 4000
FRAME = 1024
HOP = 256
WINDOW = 16
LOWEST, HIGHEST = 100.0, 1800.0
MOST_ERRORS = 0.15
LEAST_OVERLAP = 40
BLOCK_BYTES = 1 << 18
BLOCKS_HELD = 4
AT_ONCE, SAMPLES_BYTES = 32, 1 << 23
VOTES = 1 << 20

#: (kind, first pitch class, pitch classes, frames): kinds split a rectangle into a part that counts for and one against.
FILTERS = tuple((k % 6, (5 * k) % (12 - h + 1), h, w) for k, (h, w) in enumerate(zip((3, 4, 2, 6, 6, 4, 2, 6, 4, 4, 3, 6, 2, 8, 6, 12), (8, 8, 16, 8, 12, 12, 4, 16, 8, 16, 15, 6, 16, 8, 8, 12))))
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


@lru_cache
def pitch_classes() -> np.ndarray:
    """(FFT bins, 12): which pitch class a bin counts for."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hz), 12), dtype=np.float32)
    use = np.flatnonzero((hz >= LOWEST) & (hz <= HIGHEST))
    out[use, np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """(recordings, frames, 12), each frame of length 1, or 0 if it is silent; samples: (recordings, samples)."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=1)[:, ::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=2)) ** 2
    energy = power @ pitch_classes()
    # Weighted over five frames, as steps between notes fall inside frames.
    padded = np.pad(energy, ((0, 0), (2, 2), (0, 0)), mode="edge")
    energy = sum(c * padded[:, k : k + energy.shape[1]] for k, c in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    size = np.sqrt((energy**2).sum(axis=2, keepdims=True))
    return np.where(size > 1e-6, energy / np.maximum(size, 1e-6), 0)


def _halves(kind: int, h: int, w: int) -> list[tuple[int, int, int, int, int]]:
    """Rectangles (sign, frame, class, frames, classes) of a filter."""
    if kind == 0:
        return [(1, 0, 0, w, h)]
    if kind == 1:
        return [(1, 0, h // 2, w, h - h // 2), (-1, 0, 0, w, h // 2)]
    if kind == 2:
        return [(1, w // 2, 0, w - w // 2, h), (-1, 0, 0, w // 2, h)]
    if kind == 3:
        a, b = w // 2, h // 2
        return [(1, 0, 0, a, b), (1, a, b, w - a, h - b), (-1, a, 0, w - a, b), (-1, 0, b, a, h - b)]
    if kind == 4:
        third = max(1, h // 3)
        return [(1, 0, third, w, h - 2 * third), (-1, 0, 0, w, third), (-1, 0, h - third, w, third)]
    third = max(1, w // 3)
    return [(1, third, 0, w - 2 * third, h), (-1, 0, 0, third, h), (-1, w - third, 0, third, h)]


def codes(samples: np.ndarray) -> np.ndarray:
    """(recordings, codes) of equally long recordings; none if they are shorter than a window of frames."""
    if samples.shape[1] < FRAME + (WINDOW - 1) * HOP:
        return np.zeros((samples.shape[0], 0), dtype=np.uint32)
    c = chroma(samples.astype(np.float32))
    whole = np.zeros((c.shape[0], c.shape[1] + 1, 13))
    whole[:, 1:, 1:] = c.cumsum(axis=1).cumsum(axis=2)
    n = c.shape[1] - WINDOW + 1
    out = np.zeros((c.shape[0], n), dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        sums = {1: 0.0, -1: 0.0}
        for sign, f, p, fs, ps in _halves(kind, h, w):
            a, b, lo, hi = f, f + fs, y + p, y + p + ps
            sums[sign] = sums[sign] + whole[:, b : b + n, hi] - whole[:, a : a + n, hi] - whole[:, b : b + n, lo] + whole[:, a : a + n, lo]
        value = np.log((1 + sums[1]) / (1 + sums[-1]))
        middle = np.log(1 + h * w / 5) if kind == 0 else 0.0
        out = out << np.uint32(2) | GRAY[np.searchsorted([-0.35, 0.0, 0.35], value - middle, side="right")]
    return out


def pcm(value: bytes | None) -> np.ndarray:
    """Samples of little-endian 16-bit PCM at RATE; an odd last byte is left out."""
    value = value or b""
    return np.frombuffer(value[: len(value) // 2 * 2], dtype="<i2") / np.float32(32768)


def melody(vector: list[float] | None, note: int = 512) -> np.ndarray:
    """A recording for a vector: one tone for each entry, higher for larger entries.  For tables that hold no audio."""
    v = np.nan_to_num(np.array([x or 0.0 for x in vector or []], dtype=np.float64))
    steps = np.round(24 * (1 + np.clip(v / 0.3, -1, 1))).astype(int)
    return tones(note)[steps].reshape(-1)


@lru_cache
def tones(note: int) -> np.ndarray:
    t = np.arange(note) / RATE
    hz = 110.0 * 2 ** (np.arange(49) / 12)
    return (0.6 * np.sin(2 * np.pi * hz[:, None] * t) + 0.3 * np.sin(4 * np.pi * hz[:, None] * t)).astype(np.float32)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """AT_ONCE recordings, or so many as have SAMPLES_BYTES together, or one longer one."""
    a = 0
    while a < batch.num_rows:
        n = 1
        while n < AT_ONCE and a + n < batch.num_rows and batch.column(1).slice(a, n + 1).nbytes <= SAMPLES_BYTES:
            n += 1
        yield batch.slice(a, n)
        a += n


def fingerprint(recordings: DataFrame, key: str, audio: str, decode: Callable[..., np.ndarray] = pcm) -> DataFrame:
    """(``key``, codes: little-endian 32-bit integers, digest; null without codes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                waves = [decode(x) for x in part.column(1).to_pylist()]
                found: list[bytes] = [b""] * len(waves)
                for length in {len(w) for w in waves}:
                    same = [i for i, w in enumerate(waves) if len(w) == length]
                    for i, c in zip(same, codes(np.stack([waves[i] for i in same]))):
                        found[i] = c.astype("<u4").tobytes()
                digest = [hashlib.sha256(c).hexdigest() if c else None for c in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary()), pa.array(digest, pa.string())], [key, "codes", "digest"])

    return spread(recordings.select(key, audio)).mapInArrow(run, f"{key} {recordings.schema[key].dataType.simpleString()}, codes binary, digest string")


def bit_errors(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[int, int]:
    """(wrong bits, bits) where x[i + offset] stands against y[i]."""
    a = max(0, -offset)
    b = min(len(y), len(x) - offset)
    if b <= a:
        return 0, 0
    return int(np.bitwise_count(x[a + offset : b + offset] ^ y[a:b]).sum()), 32 * (b - a)


class Index:
    """The codes of a block of queries, and all that differ from them in one bit, in order."""

    def __init__(self, queries: list[tuple[object, bytes]]) -> None:
        self.keys = [k for k, _ in queries]
        self.codes = [np.frombuffer(c, dtype="<u4") for _, c in queries]
        sizes = [len(c) for c in self.codes]
        plain = np.concatenate(self.codes) if sizes else np.empty(0, dtype=np.uint32)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.empty(0, dtype=np.int32)
        flips = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint32)
        near = (plain[None] ^ flips[:, None]).reshape(-1)
        order = np.argsort(near, kind="stable")
        self.near, at = near[order], order % max(1, len(plain))
        self.owner, self.place = owner[at], place[at]

    def search(self, found: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(query, recording, offset, wrong bits, bits) of the best offset of each pair that aligns."""
        for i, c in enumerate(found):
            low, high = np.searchsorted(self.near, c, side="left"), np.searchsorted(self.near, c, side="right")
            counts = high - low
            upto = np.cumsum(counts)
            best: dict[int, tuple] = {}
            a = 0
            while a < len(c) and upto[-1]:  # so many votes at once
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + VOTES, side="right")))
                n = counts[a:b]
                at = np.repeat(low[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                offset = self.place[at].astype(np.int64) - np.repeat(np.arange(a, b), n)
                # An offset that has votes in several stretches of a long recording is judged in each, to the same end.
                for pair in np.unique(self.owner[at].astype(np.int64) << 32 | (offset & 0xFFFFFFFF)).tolist():
                    q, offset_of = pair >> 32, (pair & 0xFFFFFFFF) - ((pair & 0x80000000) << 1)
                    wrong, bits = bit_errors(self.codes[q], c, offset_of)
                    if bits >= 32 * min(LEAST_OVERLAP, len(c), len(self.codes[q])) and wrong <= MOST_ERRORS * bits:
                        rank = (wrong / bits, -bits, offset_of, wrong)
                        if q not in best or rank < best[q]:
                            best[q] = rank
                a = b
            for q, (_, bits, offset, wrong) in sorted(best.items()):
                yield q, i, offset, wrong, -bits


def packed(recordings: DataFrame, key: str, bytes_of_all: int) -> tuple[DataFrame, int]:
    """((number, recordings: array of (``key``, codes)), how many there may be): about BLOCK_BYTES of codes each."""
    many = max(1, math.ceil(bytes_of_all / BLOCK_BYTES))
    number = F.pmod(F.xxhash64(key, "codes"), F.lit(many)).cast("int")  # a key that many share fills no chunk
    return recordings.groupBy(number.alias("number")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), "codes"))).alias("recordings")), many


def align(work: Workspace, classes: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query, match, shift, wrong_bits, bits): queries and classes have (``key``, codes), keys once each."""
    kind = classes.schema[key].dataType.simpleString()
    blocks, many = packed(queries, key, total_bytes(queries, "codes"))
    blocks = work.keep(blocks.select(F.col("number").alias("block"), F.col("recordings").alias("asked")), "blocks")
    chunks, _ = packed(classes, key, total_bytes(classes, "codes"))
    # A block's row goes to executors as a broadcast only if all blocks are few bytes, which their files tell.
    pairs = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(blocks, "block").select("block", "asked", "recordings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Index] = {}
        for batch in batches:
            kind = batch.schema.field("recordings").type.value_type.field("key").type
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if block not in held:
                    if len(held) >= BLOCKS_HELD:
                        held.pop(next(iter(held)))
                    held[block] = Index([(r["key"], r["codes"]) for r in batch.column("asked")[i].as_py()])
                index, found = held[block], batch.column("recordings")[i].as_py()
                got = list(index.search([np.frombuffer(r["codes"] or b"", dtype="<u4") for r in found]))
                columns = list(zip(*got)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([index.keys[q] for q in columns[0]], kind), pa.array([found[k]["key"] for k in columns[1]], kind), *[pa.array(list(columns[k]), pa.int32()) for k in (2, 3, 4)]],
                    ["query", "match", "shift", "wrong_bits", "bits"],
                )

    return pairs.sortWithinPartitions("block").mapInArrow(run, f"query {kind}, match {kind}, shift int, wrong_bits int, bits int")


def search(spark: SparkSession, recordings: DataFrame, key: str, audio: str, is_query: Column, decode: Callable[..., np.ndarray] = pcm) -> DataFrame:
    """Members and matches.

    kind ``member``: ``key`` belongs to class_id; shift, wrong_bits and bits are 0.
    kind ``match``: the query class ``key`` aligns with class_id, at ``shift``
    codes, with wrong_bits of bits wrong.  Classes stand for all their members.
    """
    work = Workspace(spark, "chroma")
    prints = work.keep(fingerprint(recordings, key, audio, decode), "prints")
    classes = prints.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(key).alias("class_id"), F.first("codes").alias("codes"), F.max(is_query.cast("int")).alias("asked"))
    classes = work.keep(classes, "classes")
    zero = [F.lit(0).alias(c) for c in ("shift", "wrong_bits", "bits")]
    members = prints.select(key, "digest").join(classes.select("digest", "class_id"), "digest", "left").select(key, F.lit("member").alias("kind"), F.coalesce("class_id", key).alias("class_id"), *zero)
    lists = classes.withColumnRenamed("class_id", key)
    found = align(work, lists.select(key, "codes"), lists.where("asked = 1").select(key, "codes"), key)
    return members.unionByName(found.select(F.col("query").alias(key), F.lit("match").alias("kind"), F.col("match").alias("class_id"), "shift", "wrong_bits", "bits"))
