"""Compliance of imports with the layers of a design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import numbered
from ..operators.layers import file_layers, import_lines, layer_list, layers_of, violations
from ..operators.syntax import imports, syntax_nodes
from ..sources.files import lines, scan, scanned_paths
from .gate import ISSUE


def arch_issues(files: DataFrame, designs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Issues of files under a design (json); none if it has no layers.  Repeated imports are repeated issues.

    ``nodes``: syntax nodes of at least these files, if they are parsed already.
    """
    own = scan(files, "arch")
    layers = layer_list(layers_of(designs))
    edges = imports(syntax_nodes(own) if nodes is None else scanned_paths(nodes, "arch"))
    found = import_lines(violations(edges, own, layers), lines(own))
    return issues_of(found).select(*ISSUE)


def issues_of(found: DataFrame) -> DataFrame:
    rows = found.select(
        "path",
        "line_no",
        F.lit("ARCH-1").alias("rule_id"),
        F.lit("P1").alias("severity"),
        F.lit("arch_compliance").alias("category"),
        F.format_string("layer %s imports layer %s", "layer", "target_layer").alias("title"),
        F.format_string("reach %s by way of a layer in between", "target_layer").alias("suggestion"),
        F.lit(None).cast("string").alias("owasp"),
        F.lit(None).cast("string").alias("snippet"),
        F.lit(0).alias("phase"),
        F.col("seq").alias("ordinal"),
        F.lit(0).alias("seq"),
    )
    return numbered(rows, "ARCH-%03d")


def arch_summary(files: DataFrame, designs: DataFrame) -> DataFrame:
    """One row: modules_analyzed, layers_detected and constraints_checked (the number of layers)."""
    own = scan(files, "arch")
    layers = layer_list(layers_of(designs))
    return file_layers(own, [n for n, _ in layers]).agg(
        F.count("*").alias("modules_analyzed"), F.array_sort(F.collect_set("layer")).alias("layers_detected"), F.lit(len(layers)).alias("constraints_checked")
    )
