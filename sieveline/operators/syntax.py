"""Python syntax trees: calls, secret assignments and imports, from one parse of each file."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import Workspace
from .rules import CALLS, SECRET_LENGTH, SECRET_NAMES

NODES = "path string, kind string, seq int, line_no int, name string, size int"


def called_name(call: ast.Call) -> str | None:
    """The dotted name of what is called.  If it hangs on something else than a name, what is known of it."""
    parts, at = [], call.func
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    if isinstance(at, ast.Name):
        parts.append(at.id)
    return ".".join(reversed(parts)) or None


def calls_in_order(tree: ast.AST) -> Iterator[ast.Call]:
    """Calls, outer ones first; the stack stands for recursion, which long chains would exhaust."""
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, ast.Call):
            yield node
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


def nodes_of(source: str) -> list[tuple[str, int, int, str, int]]:
    """(kind, seq, line, name, length of the string) of a file; none if it can't be parsed."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = [("call", i, node.lineno, name, 0) for i, node in enumerate(calls_in_order(tree)) if (name := called_name(node))]
    seq = 0
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    out.append(("assign", seq, node.lineno, target.id, len(node.value.value)))
                    seq += 1
        elif isinstance(node, ast.Import):
            for alias in node.names:
                out.append(("import", seq, node.lineno, alias.name, 0))
                seq += 1
        elif isinstance(node, ast.ImportFrom) and node.module:
            out.append(("import", seq, node.lineno, node.module, 0))
            seq += 1
    return out


def syntax_nodes(files: DataFrame) -> DataFrame:
    """NODES of every Python file of files (path, suffix, content).

    The gate, the audit and the layers take them as an argument, so one parse,
    written by ``parsed``, serves all three.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *node) for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for node in nodes_of(source or "")]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["path", "kind", "seq", "line_no", "name", "size"])

    return files.where(F.col("suffix") == ".py").select("path", "content").mapInArrow(run, NODES)


def parsed(files: DataFrame) -> DataFrame:
    """The syntax nodes of files, written once."""
    return Workspace(files.sparkSession, "syntax").keep(syntax_nodes(files), "nodes")


def dangerous_calls(nodes: DataFrame) -> DataFrame:
    """(path, line_no, seq, name, rule_id): a lookup of a fixed list of names."""
    rule = F.create_map(*[x for rule_id, (_, names) in CALLS.items() for n in names for x in (F.lit(n), F.lit(rule_id))])
    return nodes.where("kind = 'call'").withColumn("rule_id", rule[F.col("name")]).where("rule_id IS NOT NULL").select("path", "line_no", "seq", "name", "rule_id")


def secret_assignments(nodes: DataFrame) -> DataFrame:
    """(path, line_no, seq, name, rule_id, snippet): string constants assigned to names that tell of secrets; the value is masked."""
    tells = F.lit(False)
    for part in SECRET_NAMES:
        tells = tells | F.contains(F.lower("name"), F.lit(part))
    found = nodes.where((F.col("kind") == "assign") & (F.col("size") >= SECRET_LENGTH) & tells)
    return found.select("path", "line_no", "seq", "name", F.lit("AUD-AST-1").alias("rule_id"), F.concat("name", F.lit(" = '***'")).alias("snippet"))


def imports(nodes: DataFrame) -> DataFrame:
    """(path, seq, module)"""
    return nodes.where("kind = 'import'").select("path", "seq", F.col("name").alias("module"))
