"""Token ids packed into rows of fixed capacity by best-fit decreasing.

Texts become ids with an end id.  Rows of the table are dealt to shards by the
hash of their key, text and place in the input, so neither a key nor a text that
many rows share fills one; the number of shards follows the bytes of text, and
each shard is a partition of its own, so a task holds about ``SHARD_BYTES`` of
text, or one longer text, at any input size.  In a shard, texts longer than a row
are cut into full rows and a rest, without loss.  Pieces are placed longest
first, each into the open row whose free space is the least that fits; a
segment tree over capacities finds it in O(log capacity).  A shard gives a
matrix of ids, one table row for each row of it, with cumulative segment
lengths and the places where positions begin again.

Defined results: null and empty texts are the end id alone; equal lengths go
in order of key, then of piece, then of input; repeated rows are packed each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.spread import spread
from .language import pieces_of
from .shared import kept_in_worker, steady, total_bytes, trimmed

CAPACITY = 2048
SHARD_BYTES = 24 << 20
PAD = 0


class Capacities:
    """Open rows by free space; the least free space of at least n is found from a segment tree of counts."""

    def __init__(self, most: int) -> None:
        self.size = 1 << max(0, math.ceil(math.log2(most + 1)))
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.open[free].append(row)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        k = free + self.size
        while k:
            self.tree[k] += by
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(free space, row) with the least free space >= ``least``; the row is no longer open."""
        k = least + self.size
        if not self.tree[k]:
            # up until a right sibling has open rows, then down its left side
            while k > 1 and (k & 1 or not self.tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        free = k - self.size
        row = self.open[free].pop()
        self._change(free, -1)
        return free, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices of pieces, none longer than ``capacity``; the order of equal lengths is kept."""
    capacities = Capacities(capacity)
    rows: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = capacities.take(lengths[i])
        if found is None:
            rows.append([i])
            free, row = capacity - lengths[i], len(rows) - 1
        else:
            free, row = found[0] - lengths[i], found[1]
            rows[row].append(i)
        if free:
            capacities.add(free, row)
    return rows


def rank_encoder(path: str) -> Callable[[str], list[int]]:
    """An encoder of a rank file of the tiktoken library; the end id is the number of ranks."""
    import public_tokenizers
    import tiktoken

    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path].encode_ordinary


_ENCODERS: dict[str, object] = kept_in_worker("packing")


def encode(docs: DataFrame, path: str, end: int, key: str, text: str) -> DataFrame:
    """(``key``, ids: little-endian 16-bit integers, the end id last; place: a number that no other row has)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = rank_encoder(path)
        # A task that runs again numbers its rows the same.
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces_of(batch, 1, 1 << 21):
                ids = [np.array([*encoder(t), end] if t else [end], dtype="<u2").tobytes() for t in part.column(1).to_pylist()]
                places = pa.array(range(place, place + len(ids)), pa.int64())
                place += len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), places], [key, "ids", "place"])

    return steady(spread(docs.select(key, text))).mapInArrow(trimmed(run, "packing"), f"{key} {docs.schema[key].dataType.simpleString()}, ids binary, place bigint")


def pack(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of packed matrices.

    shard, row: the matrix and the row in it.  ids: ``capacity`` little-endian
    16-bit integers, padded with PAD.  cu_seqlens: 0 and the end of each
    segment.  position_resets: where a segment, and so a position of 0, begins.
    keys, piece_starts: the text of each segment and the place of its first id
    in the ids of that text.
    """
    shards = max(1, math.ceil(total_bytes(docs, text) / SHARD_BYTES))
    kind = docs.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        keys = table.column(key).to_pylist()
        ids = [np.frombuffer(x, dtype="<u2") for x in table.column("ids").to_pylist()]
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] if keys[i] is not None else 0, ids[i].tobytes()))
        pieces = [(i, a) for i in order for a in range(0, len(ids[i]), capacity)]
        rows = best_fit_decreasing([min(capacity, len(ids[i]) - a) for i, a in pieces], capacity)
        matrix, ends, owners, starts = [], [], [], []
        for row in rows:
            parts = [ids[i][a : a + capacity] for i, a in (pieces[p] for p in row)]
            filled = np.full(capacity, PAD, dtype="<u2")
            whole = np.concatenate(parts)
            filled[: len(whole)] = whole
            matrix.append(filled.tobytes())
            ends.append([0, *np.cumsum([len(p) for p in parts]).tolist()])
            owners.append([keys[pieces[p][0]] for p in row])
            starts.append([pieces[p][1] for p in row])
        shard = table.column("shard")[0].as_py()
        return pa.table(
            {
                "shard": pa.array([shard] * len(rows), pa.int32()),
                "row": pa.array(range(len(rows)), pa.int32()),
                "ids": pa.array(matrix, pa.binary()),
                "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
                "position_resets": pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
                "keys": pa.array(owners, pa.list_(table.column(key).type)),
                "piece_starts": pa.array(starts, pa.list_(pa.int64())),
            }
        )

    coded = encode(docs, path, end, key, text).withColumn("shard", F.pmod(F.xxhash64(key, "ids", "place"), F.lit(shards)).cast("int"))
    return coded.drop("place").repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(run, f"shard int, row int, ids binary, cu_seqlens array<int>, position_resets array<int>, keys array<{kind}>, piece_starts array<bigint>")


def positions(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """The position of each id of a row in its segment; 0 in the padding."""
    out = np.zeros(capacity, dtype=np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out


def unpack(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, ids) of each text, from packed rows; keys must be unique."""
    part = F.expr("transform(sequence(0, size(keys) - 1), i -> struct(keys[i] AS key, piece_starts[i] AS start, substring(ids, 2 * cu_seqlens[i] + 1, 2 * (cu_seqlens[i + 1] - cu_seqlens[i])) AS part))")
    pieces = packed.select(F.explode(part).alias("p")).select("p.*")
    return pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", F.hex("part").alias("part")))).alias("parts")).select(F.col("key").alias(key), F.unhex(F.array_join("parts.part", "")).alias("ids"))
