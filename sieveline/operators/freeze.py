"""Frozen specifications: what a design promises, and what a later design breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layers import LAYER

#: Severities by kind of violation.
KINDS = {"module_removed": "P0", "api_removed": "P0", "model_removed": "P1", "field_removed": "P1"}

MODULE = "struct<name:string,responsibility:string,public_api:array<string>,dependencies:array<string>,key_entities:array<string>>"
FIELD = "struct<name:string,type:string,description:string,nullable:boolean>"
RELATION = "struct<target:string,type:string,description:string>"
ENTITY = f"struct<name:string,fields:array<{FIELD}>,relationships:array<{RELATION}>>"
ENDPOINT = "struct<method:string,path:string,description:string>"
DESIGN = (
    f"struct<architecture:struct<overview:string,mermaid_diagram:string,layers:array<{LAYER}>>,"
    "tech_stack:struct<language:string,framework:string,database:string,cache:string,message_queue:string,other:array<string>>,"
    f"modules:array<{MODULE}>,data_model:struct<entities:array<{ENTITY}>>,api_design:struct<style:string,endpoints:array<{ENDPOINT}>>,"
    "coding_standards:struct<max_line_length:int,naming_style:string,require_type_annotations:boolean,require_docstrings:boolean,error_handling_pattern:string>>"
)


def parsed(designs: DataFrame, json: str = "json") -> DataFrame:
    """(design) of documents as JSON text."""
    return designs.select(F.from_json(json, DESIGN).alias("design"))


def _last_of_name(rows: DataFrame, item: str) -> DataFrame:
    """One row for each name, the last in the document."""
    return rows.groupBy(F.coalesce(f"{item}.name", F.lit("unknown")).alias("name")).agg(F.max_by(item, "pos").alias(item))


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def modules(designs: DataFrame) -> DataFrame:
    """(name, responsibility, public_api, dependencies)"""
    rows = _last_of_name(designs.select(F.posexplode("design.modules").alias("pos", "m")), "m")
    return rows.select("name", F.coalesce("m.responsibility", F.lit("")).alias("responsibility"), F.coalesce("m.public_api", empty("string")).alias("public_api"), F.coalesce("m.dependencies", empty("string")).alias("dependencies"))


def models(designs: DataFrame) -> DataFrame:
    """(name, fields, relationships)"""
    rows = _last_of_name(designs.select(F.posexplode("design.data_model.entities").alias("pos", "e")), "e")
    return rows.select("name", F.coalesce("e.fields", empty(FIELD)).alias("fields"), F.coalesce("e.relationships", empty(RELATION)).alias("relationships"))


def endpoints(designs: DataFrame) -> DataFrame:
    """(pos, method, path, description)"""
    return designs.select(F.posexplode("design.api_design.endpoints").alias("pos", "e")).select("pos", "e.method", "e.path", "e.description")


def api_style(designs: DataFrame) -> DataFrame:
    return designs.where("design.api_design IS NOT NULL").select(F.coalesce("design.api_design.style", F.lit("REST")).alias("style"))


def layer_constraints(designs: DataFrame) -> DataFrame:
    rows = designs.select(F.posexplode("design.architecture.layers").alias("pos", "l"))
    return rows.select("pos", F.coalesce("l.name", F.lit("")).alias("name"), F.coalesce("l.forbidden_dependencies", empty("string")).alias("forbidden"), F.coalesce("l.allowed_dependencies", empty("string")).alias("allowed"))


def fields(of: DataFrame) -> DataFrame:
    """(model, field) of models (name, fields)"""
    return of.select(F.col("name").alias("model"), F.explode("fields").alias("f")).select("model", F.coalesce("f.name", F.lit("")).alias("field")).distinct()


def modules_removed(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """(name) of frozen modules that the current design lacks."""
    return frozen.select("name").join(current.select("name"), "name", "left_anti")


def apis_removed(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """(name, removed) of modules in both whose public functions became fewer; removed is in order."""
    now = current.select("name", F.col("public_api").alias("_now"))
    both = frozen.select("name", "public_api").join(now, "name")
    return both.select("name", F.array_sort(F.array_except("public_api", "_now")).alias("removed")).where(F.size("removed") > 0)


def models_removed(frozen: DataFrame, current: DataFrame) -> DataFrame:
    return modules_removed(frozen, current)


def fields_removed(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """(model, field) that models in both lost."""
    kept = fields(frozen).join(current.select(F.col("name").alias("model")), "model", "left_semi")
    return kept.join(fields(current), ["model", "field"], "left_anti")


def compliance(frozen_modules: DataFrame, current_modules: DataFrame, frozen_models: DataFrame, current_models: DataFrame) -> DataFrame:
    """(type, severity, subject, detail) of every violation."""
    text = F.lit("").alias("detail")
    parts = {
        "module_removed": modules_removed(frozen_modules, current_modules).select(F.col("name").alias("subject"), text),
        "api_removed": apis_removed(frozen_modules, current_modules).select(F.col("name").alias("subject"), F.array_join("removed", ",").alias("detail")),
        "model_removed": models_removed(frozen_models, current_models).select(F.col("name").alias("subject"), text),
        "field_removed": fields_removed(frozen_models, current_models).select(F.col("model").alias("subject"), F.col("field").alias("detail")),
    }
    out = None
    for kind, rows in parts.items():
        rows = rows.select(F.lit(kind).alias("type"), F.lit(KINDS[kind]).alias("severity"), "subject", "detail")
        out = rows if out is None else out.unionByName(rows)
    return out


def compliant(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("violations"), (F.count("*") == 0).alias("compliant"))


def ratchet(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new by name; where both have a name the new one stands, whole."""
    columns = [c for c in new.columns if c != "name"]
    o = old.select("name", F.struct(*columns).alias("_old"))
    n = new.select("name", F.struct(*columns).alias("_new"))
    return o.join(n, "name", "full").select("name", F.coalesce("_new", "_old").alias("_it")).select("name", "_it.*")


def merge_endpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """All old endpoints, and new ones whose method and path no old one has; null equals null.  Equal new ones all stay."""
    known = old.select(F.col("method").alias("_m"), F.col("path").alias("_p"))
    added = new.join(known, F.col("method").eqNullSafe(F.col("_m")) & F.col("path").eqNullSafe(F.col("_p")), "left_anti")
    return old.withColumn("origin", F.lit("old")).unionByName(added.withColumn("origin", F.lit("new")))


def freeze_counts(of_modules: DataFrame, of_models: DataFrame) -> DataFrame:
    """One row: numbers of frozen modules and models."""
    return of_modules.agg(F.count("*").alias("modules")).crossJoin(of_models.agg(F.count("*").alias("models")))  # one row each
