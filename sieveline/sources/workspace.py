"""Workspace documents, JSON sinks and generated files."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import CONTEXT_FILES


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_document(spark: SparkSession, name: str, *folders: str, required: bool = True) -> DataFrame:
    """(json) of the first folder that has the document; without one an error, or one row of an empty object."""
    for folder in folders:
        if _there(spark, f"{folder}/{name}"):
            return spark.read.text(f"{folder}/{name}", wholetext=True).select(F.col("value").alias("json"))
    if required:
        raise FileNotFoundError(name)
    return spark.createDataFrame([("{}",)], "json string")


def read_context_files(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, file_name, json) of the context files that are there and hold JSON, in the order of their reading."""
    found = [f for f in CONTEXT_FILES if _there(spark, f"{folder}/{f}")]
    if not found:
        return spark.createDataFrame([], "ord int, file_name string, json string")
    rows = spark.read.text([f"{folder}/{f}" for f in found], wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), F.col("value").alias("json"))
    order: Column = F.create_map(*[F.lit(x) for i, f in enumerate(CONTEXT_FILES) for x in (f, i)])
    return rows.where(F.try_parse_json("json").isNotNull()).select(order[F.col("file_name")].alias("ord"), "file_name", "json").orderBy("ord")


def write_document(df: DataFrame, path: str) -> None:
    """One JSON object as an indented file; df has one row."""
    import json

    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(json.loads(rows[0]), ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def append_json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def as_json_lines(df: DataFrame) -> DataFrame:
    """(json) of each row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_generated(files: DataFrame, folder: str) -> DataFrame:
    """Write files (path, content: text or binary) below a folder that all executors share, by way of a name of its own each.

    Paths that are empty, absolute or lead out of the folder are refused.
    Returns (path, written).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        for batch in batches:
            written = []
            for path, content in zip(*[c.to_pylist() for c in batch.columns]):
                tidy = posixpath.normpath(path or ".")
                safe = not (tidy.startswith(("/", "..")) or tidy == ".")
                if safe:
                    place = os.path.join(folder, tidy)
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    with open(f"{place}.{uuid.uuid4().hex}", "wb") as out:
                        out.write(content.encode() if isinstance(content, str) else content or b"")
                    os.replace(out.name, place)  # a task that runs again leaves the same file
                written.append(safe)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written, pa.bool_())], ["path", "written"])

    return files.select("path", "content").mapInArrow(run, "path string, written boolean")
