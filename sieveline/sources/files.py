"""Source files and their lines."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name, suffix
from ..operators.rules import EXCLUDED, SUFFIXES


#: Folders that are handed to executors to list: the driver goes down until it has so many, or no more.
FOLDERS = 256


def files_from_dir(spark: SparkSession, root: str, check: str | None = None) -> DataFrame:
    """(path, file_name, suffix, parts, content) of the files below a folder; content is null if it isn't UTF-8.

    With a check, its excluded folders are not entered and only names with its
    suffixes are read.  Executors list and read; unlike Spark's own listing
    this one has files whose name begins with _ or a dot, as ``__init__.py``.
    """
    found = read_files(list_files(spark, root, SUFFIXES[check] if check else None, EXCLUDED[check] if check else ()))
    path = F.regexp_replace("path", r"^file:/+", "/")
    return with_path_parts(found.select(path.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")))


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path) of files below a folder, outside excluded folders, with one of the suffixes.

    The driver lists the uppermost folders, breadth first, until there are
    FOLDERS; each of those is walked by a task.
    """
    system, base = _file_system(root)
    lead = root.split("://")[0] + "://" if "://" in root else ""

    def entries(fs: pafs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
        """Files and folders in a folder."""
        infos = [i for i in fs.get_file_info(pafs.FileSelector(folder)) if i.base_name not in excluded]
        files = [i.path for i in infos if i.type == pafs.FileType.File and (suffixes is None or i.path.endswith(suffixes))]
        return files, [i.path for i in infos if i.type == pafs.FileType.Directory]

    above: list[str] = []
    folders = [base] if not set(base.strip("/").split("/")) & set(excluded) else []
    while folders and len(folders) < FOLDERS:
        files, below = zip(*[entries(system, f) for f in folders])
        above += sum(files, [])
        folders = sum(below, [])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not folder:
                    yield pa.RecordBatch.from_arrays([pa.array([place])], ["path"])
                    continue
                fs, waiting = _file_system(place)[0], [place.removeprefix(lead) if lead else place]
                while waiting:
                    files, below = entries(fs, waiting.pop())
                    waiting += below
                    if files:
                        yield pa.RecordBatch.from_arrays([pa.array([lead + f for f in files])], ["path"])

    rows = [(lead + f, False) for f in above] + [(lead + f, True) for f in folders]
    if not rows:
        return spark.createDataFrame([], "path string")
    spread = spark.createDataFrame(rows, "path string, folder boolean").repartition(min(len(rows), max(FOLDERS, spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(walk, "path string")


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else os.path.abspath(path))


def read_files(paths: DataFrame) -> DataFrame:
    """(path, content) of files (path), read on the executors, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _file_system(path)
                with system.open_input_file(name) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    return paths.mapInArrow(run, "path string, content binary")


def files_from_table(table: DataFrame, path: Column, text: Column) -> DataFrame:
    """The same columns for a table of texts, under made-up paths."""
    return with_path_parts(table.select(path.alias("path"), text.alias("content")))


def with_path_parts(files: DataFrame) -> DataFrame:
    named = files.withColumn("file_name", file_name(F.col("path")))
    return named.withColumn("suffix", suffix(F.col("file_name"))).withColumn("parts", F.split("path", "/")).select("path", "file_name", "suffix", "parts", *[c for c in files.columns if c != "path"])


def scan(files: DataFrame, check: str) -> DataFrame:
    """The files that a check reads: its suffixes, outside its excluded folders."""
    outside = ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED[check]]))
    return files.where(F.col("suffix").isin(*SUFFIXES[check]) & outside)


def scanned_paths(rows: DataFrame, check: str) -> DataFrame:
    """rows (path, ...) of files that a check reads."""
    name = file_name(F.col("path"))
    outside = ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED[check]]))
    return rows.where(suffix(name).isin(*SUFFIXES[check]) & outside)


def lines(files: DataFrame) -> DataFrame:
    """(path, file_name, suffix, line_no, line); any newline counts, the last line may be empty; files without content have none."""
    text = F.regexp_replace("content", "\r\n?", "\n")
    split = files.where(F.col("content").isNotNull()).select("path", "file_name", "suffix", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return split.withColumn("line_no", F.col("line_no") + 1)


def files_scanned(files: DataFrame, check: str) -> DataFrame:
    """One row: how many files the check takes up, those it can't read included."""
    return scan(files, check).agg(F.count("*").alias("files_scanned"))
