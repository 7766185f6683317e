"""Deduplication, order and numbers of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import directory
from ..sources.kept import Workspace

#: The order of a report: files by folder and name, then by check, rule, line and place.
ORDER = ("phase", "ordinal", "line_no", "seq")


def keep_first(rows: DataFrame, *key: str) -> DataFrame:
    """The first row of each key in report order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*ORDER))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def numbered(rows: DataFrame, form: str, lead: str | None = None) -> DataFrame:
    """rows with ``id``: ``form`` of the row's number, from 1, in the order (folder, path, ORDER).

    ``lead``: a column that is the same throughout a file and stands before the folder.

    The rows are written once, as numbers read them three times.  A row's
    number is that in its file, plus the rows of files before it in its range of
    files, plus those of ranges before: one row for each range passes through a
    single task, whatever the size of a folder.
    """
    work = Workspace(rows.sparkSession, "findings")
    rows = work.keep(rows, "rows")
    folder = F.coalesce(directory(F.col("path")), F.lit(""))
    files = rows.groupBy(F.struct((F.col(lead) if lead else F.lit(0)).alias("lead"), folder.alias("folder")).alias("_dir"), "path").agg(F.count("*").alias("_n"))
    # Written too: where ranges begin is found by sampling, and must be the same for both sums.
    files = work.keep(files.repartitionByRange("_dir", "path").withColumn("_range", F.spark_partition_id()), "files")
    earlier = lambda x, part, *order: F.coalesce(F.sum(x).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = files.groupBy("_range").agg(F.sum("_n").alias("_all")).withColumn("_ahead", earlier("_all", [], "_range")).select("_range", "_ahead")
    offsets = files.withColumn("_within", earlier("_n", ["_range"], "_dir", "path")).join(ranges, "_range").select("path", (F.col("_within") + F.col("_ahead")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("path").orderBy(*ORDER))
    return rows.withColumn("_own", own).join(offsets, "path").withColumn("id", F.format_string(form, F.col("_own") + F.col("_offset"))).drop("_own", "_offset")


def count_of(column: Column, value: str) -> Column:
    return F.count_if(column == value)
