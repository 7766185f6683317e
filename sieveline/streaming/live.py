"""The log and the gate over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import match
from ..operators.rules import Rule
from ..sources.files import lines, with_path_parts
from ..sources.trace import parsed


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """RECORDs of log files, with their other keys, as they arrive."""
    return parsed(spark.readStream.text(folder))


def last_per_step_stream(log: DataFrame) -> DataFrame:
    """The last record of each step so far, by its time; state is one row a step."""
    rest = F.struct(*[c for c in log.columns if c != "step"])
    return log.groupBy("step").agg(F.max_by(rest, "timestamp").alias("_r")).select("step", "_r.*")


def steps_by_window(log: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Records by window of time and step; a window is closed when nothing can come that late."""
    timed = log.withColumn("ts", F.to_timestamp("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "step").agg(F.count("*").alias("n"))


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder as they arrive."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    return with_path_parts(raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")))


def matches_stream(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Matches of rules in arriving files; nothing is kept between batches."""
    return match(lines(files), rules).select("path", "line_no", "rule_id")


def run_to_table(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, into a table in memory, then stop."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
