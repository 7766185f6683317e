"""What several steps of a plan read is written once, under ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What holds while a table is written: shuffle files go when their query ends, and batches for Python are bounded by bytes too.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_ROOTS: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names.

    Where none is named, a temporary one if driver and executors are one
    process; on a cluster that is an error, as executors don't share such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = getattr(checkpoint_dir, "own", None) or tempfile.mkdtemp(prefix="sieveline-")
        checkpoint_dir.own = named
    return named.rstrip("/")


class Workspace:
    """Tables of one operator's run.  ``keep`` cuts the lineage; ``drop`` frees a table no later step reads."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again; the shuffle files of its plan go as soon as it is written."""
        path = f"{self.root}/{name}"
        schema = df.schema
        with writing(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Queries that run within have the settings of WRITING."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators keep within are deleted at the end: what is to stay must have been written elsewhere."""
    first = len(_ROOTS)
    try:
        yield
    finally:
        for root in _ROOTS[first:]:
            _delete(spark, root)
        del _ROOTS[first:]


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names that aren't taken, in any case: the wanted ones, with marks before them as need be."""
    known = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        out.append(name)
    return out
