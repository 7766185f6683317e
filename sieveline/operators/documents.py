"""Transforms of workspace documents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .freeze import empty

RESEARCH = (
    "struct<market_analysis:struct<target_users:array<string>>,user_pain_points:array<struct<pain_point:string,severity:string,current_workaround:string>>,"
    "opportunity_windows:array<struct<opportunity:string,urgency:string,suggested_approach:string>>,recommendation:struct<go_no_go:string,reasoning:string>>"
)
#: Our own words where a document says nothing.
NO_FEATURES = "core feature (to be defined)"
METRICS = ("user growth", "feature completion", "no blocking issues")
#: Context files in the order of their reading, keys of the technology stack, and defaults of the standards.
CONTEXT_FILES = ("research.json", "define.json", "design.json", "generate.json", "frozen_spec.json")
STACK = ("language", "framework", "database", "cache", "message_queue")
STANDARDS = {"max_line_length": "120", "naming_style": "snake_case", "require_type_annotations": "True", "require_docstrings": "True", "error_handling_pattern": "try-except"}


def define(researches: DataFrame, json: str = "json") -> DataFrame:
    """product_goal, target_users, core_features, pain_points_addressed and success_metrics of research documents."""
    doc = F.from_json(json, RESEARCH)
    said = F.filter(F.transform(F.coalesce(doc["opportunity_windows"], F.from_json(F.lit("[]"), "array<struct<opportunity:string,urgency:string,suggested_approach:string>>")), lambda o: o["suggested_approach"]), lambda x: F.coalesce(x, F.lit("")) != "")
    pains = F.transform(doc["user_pain_points"], lambda p: F.coalesce(p["pain_point"], F.lit("")))
    return researches.select(
        *[c for c in researches.columns if c != json],
        F.coalesce(doc["recommendation"]["reasoning"], F.lit("")).alias("product_goal"),
        F.coalesce(doc["market_analysis"]["target_users"], empty("string")).alias("target_users"),
        F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(NO_FEATURES))).alias("core_features"),
        F.coalesce(pains, empty("string")).alias("pain_points_addressed"),
        F.array(*[F.lit(m) for m in METRICS]).alias("success_metrics"),
    )


def tech_stack(stack: Column) -> Column:
    """A map of the stack's entries that aren't empty, and the other tools in one."""
    named = F.create_map(*[x for k in STACK for x in (F.lit(k), F.coalesce(stack[k], F.lit("")))])
    named = F.map_filter(named, lambda k, v: v != "")
    other = F.when(F.size(F.coalesce(stack["other"], empty("string"))) > 0, F.create_map(F.lit("other_tools"), F.array_join(stack["other"], ", ")))
    return F.coalesce(F.map_concat(named, other), named)


def coding_standards(standards: Column) -> Column:
    """A map of standards as text, with defaults; empty if there are none at all."""

    def text(k: str) -> Column:
        value = standards[k].cast("string")
        return F.coalesce(F.initcap(value) if k.startswith("require") else value, F.lit(STANDARDS[k]))

    whole = F.create_map(*[x for k in STANDARDS for x in (F.lit(k), text(k))])
    return F.when(standards.isNotNull(), whole).otherwise(F.create_map().cast("map<string,string>"))


def constraints(layers: Column) -> Column:
    """Texts of all forbidden, then all allowed dependencies of layers, each once, in order."""

    def of(part: str, form: str) -> Column:
        return F.flatten(F.transform(layers, lambda x: F.transform(F.coalesce(x[part], empty("string")), lambda d: F.format_string(form, F.coalesce(x["name"], F.lit("")), d))))

    both = F.concat(of("forbidden_dependencies", "layer %s must not depend on layer %s"), of("allowed_dependencies", "layer %s may depend on layer %s"))
    return F.coalesce(F.array_distinct(both), empty("string"))


def context(designs: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """One row of tech_stack, coding_standards, architecture_constraints and frozen_specs for a design; frozen has one row (json)."""
    d = F.col("design")
    out = designs.select(tech_stack(d["tech_stack"]).alias("tech_stack"), coding_standards(d["coding_standards"]).alias("coding_standards"), constraints(d["architecture"]["layers"]).alias("architecture_constraints"))
    if frozen is None:
        return out.withColumn("frozen_specs", F.lit(None).cast("string"))
    return out.join(frozen.select(F.col("json").alias("frozen_specs")), F.lit(True), "left")


def as_markdown(contexts: DataFrame) -> DataFrame:
    """(markdown) of contexts: a section for each part that has something."""

    def section(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"### {title}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n")))

    entries = lambda c: F.transform(F.map_entries(c), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    frozen = F.when(F.col("frozen_specs").isNotNull(), F.concat(F.lit("### Frozen specification\n```json\n"), "frozen_specs", F.lit("\n```\n")))
    parts = [F.lit("## Context\n"), section("Technology", entries("tech_stack")), section("Standards", entries("coding_standards")), section("Constraints", F.col("architecture_constraints")), frozen]
    return contexts.select(F.concat_ws("\n", *parts).alias("markdown"))


def extract_json(answers: DataFrame, content: str = "content") -> DataFrame:
    """answers with json: the content if it is JSON, else what stands in its first fence marked json, else the first fence that is JSON; and error, the first 500 characters where nothing is."""
    text = F.trim(F.regexp_replace(content, r"(?U)^\s+|\s+$", ""))
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull() & (x != ""), x)
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    marked = F.regexp_extract(text, r"(?s)^.*?```json(.*?)```", 1)
    fences = F.filter(F.split(text, "```"), lambda x, i: i % 2 == 1)
    any_fence = F.get(F.filter(F.transform(fences, lambda x: valid(trimmed(x))), lambda x: x.isNotNull()), F.lit(0))
    found = F.coalesce(valid(text), valid(trimmed(marked)), any_fence)
    return answers.withColumn("json", found).withColumn("error", F.when(F.col("json").isNull(), F.substring(text, 1, 500)))


def canonical_hash(documents: DataFrame, json_column: str = "json") -> DataFrame:
    """documents with hash: 12 digits of the SHA-256 of the JSON with sorted keys; null where it is none.

    Python writes the bytes that are hashed, so that its number and separator
    formats are met.
    """
    at = documents.columns.index(json_column)

    def digest(value: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(value or ""), sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()[:12]
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([digest(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "hash"])

    from pyspark.sql.types import StringType, StructField, StructType

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField("hash", StringType())]))


def generated_files(bundles: DataFrame, json: str = "json") -> DataFrame:
    """(path, language, content) of the files of generated bundles."""
    return bundles.select(F.explode(F.from_json(json, "struct<files:array<struct<path:string,language:string,content:string,description:string>>>")["files"]).alias("f")).select("f.path", "f.language", "f.content")


def shown_files(files: DataFrame, most: int = 20) -> DataFrame:
    """The first files in order of path, and a row that tells how many more there are."""
    shown = files.select("path").orderBy("path").limit(most)
    rest = files.agg((F.count("*") - most).alias("n")).where("n > 0").select(F.format_string("+%d more", "n").alias("path"))
    return shown.unionByName(rest)
