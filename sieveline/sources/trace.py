"""The decision log: JSON lines, appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = 500
KEYS = ("timestamp", "step", "model", "parameters", "prompt_template_version", "input_summary", "output_hash")
RECORD = "timestamp string, step string, model string, parameters struct<temperature:double,max_tokens:int>, prompt_template_version string, input_summary string, output_hash string"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """RECORDs of a log, with extra: a map of the other keys, values that aren't strings as JSON.  Blank and malformed lines are left out."""
    return parsed(spark.read.text(path))


def parsed(text: DataFrame) -> DataFrame:
    """The same of lines (value)."""
    fields = F.from_json("value", RECORD)
    every = F.from_json("value", "map<string,string>")
    rows = text.where(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"))
    return rows.select(fields.alias("r"), F.map_filter(every, lambda k, v: ~k.isin(*KEYS)).alias("extra")).select("r.*", "extra")


def make_records(steps: DataFrame, *extra: str) -> DataFrame:
    """RECORDs of steps (timestamp, step, model, temperature, max_tokens, template, summary, output), and their ``extra`` columns; template and output are contents or null."""
    return steps.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        "step",
        "model",
        F.struct(F.col("temperature").cast("double").alias("temperature"), F.col("max_tokens").cast("int").alias("max_tokens")).alias("parameters"),
        F.coalesce(F.substring(F.sha2("template", 256), 1, 8), F.lit("unknown")).alias("prompt_template_version"),
        F.substring("summary", 1, SUMMARY).alias("input_summary"),
        F.coalesce(F.substring(F.sha2("output", 256), 1, 12), F.lit("n/a")).alias("output_hash"),
        *extra,
    )


def with_extra(fields: DataFrame, extra: str = "extra", record: str = "record") -> DataFrame:
    """record, a map, with the entries of extra in place of its own of the same key."""
    own = F.map_filter(record, lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(F.col(extra), F.create_map().cast("map<string,string>"))), k))
    return fields.withColumn(record, F.coalesce(F.map_concat(own, extra), F.col(record)))


def last_per_step(log: DataFrame, order: str) -> DataFrame:
    """The last record of each step by ``order``."""
    return log.groupBy("step").agg(F.max_by(F.struct(*[c for c in log.columns if c != "step"]), order).alias("_r")).select("step", "_r.*")
