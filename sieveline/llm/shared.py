"""What the operators share: hashes of rows, bounded samples, the held-out fold.  Tables are kept by ``sources.kept``."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.kept import Workspace, checkpoint_dir, scratch, unused

__all__ = ["Workspace", "checkpoint_dir", "give_back", "held_out", "kept_in_worker", "make_room", "row_hash", "sample", "scratch", "steady", "total_bytes", "trimmed", "unused"]


def give_back() -> None:
    """Return to the system what this Python worker has freed: workers live on through stages that have no use for them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: dict[str, dict] = {}


def kept_in_worker(owner: str) -> dict:
    """A dict that an operator keeps in this Python worker from task to task, until a task of another one begins."""
    return _KEPT.setdefault(owner, {})


def make_room(owner: str = "") -> None:
    """Empty what other operators keep in this Python worker: no later task of theirs may come."""
    others = [x for name, x in _KEPT.items() if name != owner and x]
    for x in others:
        x.clear()
    if others:
        give_back()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over the batches of a task of ``owner``: room is made at its beginning, and memory given back at its end."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return outer


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns: rows that are equal have one, whatever their order or partition."""
    plain = lambda f: isinstance(f.dataType, T.AtomicType)
    name = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    return F.xxhash64(*[x for i, f in enumerate(df.schema) for x in (F.when(name(f).isNull(), F.lit(i)), name(f) if plain(f) else F.to_json(F.struct(name(f))))])


def steady(df: DataFrame) -> DataFrame:
    """df in an order that a task that runs again sees too, for operators that number rows by their place in a task.

    What comes from a shuffle arrives in any order, so it is sorted by hash
    within each partition; a plain scan stays as it is.
    """
    if not re.search(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()):
        return df
    (h,) = unused(df.columns, "_h")
    return df.withColumn(h, row_hash(df)).sortWithinPartitions(h).drop(h)


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` different rows, those with the least hash, with the column ``_h``.

    Which ones does not depend on the order of rows or on partitions, and a
    key with many rows counts for each of them.  Only hashes are shuffled and
    sent on; ``most`` of them bound the broadcast.
    """
    hashed = rows.withColumn("_h", row_hash(rows))
    least = hashed.select("_h").distinct().orderBy("_h").limit(most)
    return hashed.join(F.broadcast(least), "_h", "left_semi").dropDuplicates(["_h"])


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5, is 0.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of text in a column: what the number of parts of a shuffle follows."""
    return df.select(F.sum(F.octet_length(column).cast("long")).alias("n")).first()["n"] or 0
