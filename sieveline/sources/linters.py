"""External linters, where they are installed on the executors."""

from __future__ import annotations

import itertools
import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMEOUT = 30
#: How the linters' levels are read.
PYLINT_LEVELS = {"error": "P0", "fatal": "P0", "warning": "P1", "refactor": "P2", "convention": "P2"}
ESLINT_LEVELS = {"2": "P0", "1": "P1", "0": "P2"}

ISSUES = "path string, line_no int, severity string, title string, suggestion string"


def level(column: Column, levels: dict[str, str]) -> Column:
    """A linter's level as a severity; P2 for levels we don't know."""
    known = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return F.coalesce(known[column], F.lit("P2"))


@dataclass(frozen=True)
class Form:
    """How a tool writes what it finds: the key of a file's messages (None if the list is of messages), of a message's
    level, text and rule, the level it has if none is written, and what levels mean."""

    messages: str | None
    level: str
    rule: str
    unlevelled: str
    levels: dict[str, str]


FORMS = {"pylint": Form(None, "type", "symbol", "", PYLINT_LEVELS), "eslint": Form("messages", "severity", "ruleId", "2", ESLINT_LEVELS)}


def parse(tool: str, output: str) -> list[tuple[int, str, str, str]]:
    """(line, severity, title, suggestion) of a linter's JSON."""
    form = FORMS[tool]
    found = json.loads(output) if output.strip() else []
    if form.messages:
        found = itertools.chain.from_iterable(each.get(form.messages, ()) for each in found)
    rows = []
    for message in found:
        said = str(message.get(form.level, form.unlevelled))
        rows.append((message.get("line", 0), form.levels.get(said, "P2"), message.get("message", ""), f"{tool}: {message.get(form.rule, '')}"))
    return rows


def lint(files: DataFrame, tool: str) -> DataFrame:
    """ISSUES of every file of files (path, suffix, content); a file that the linter fails on has none."""
    suffixes = {"pylint": (".py",), "eslint": (".js", ".ts")}[tool]
    option = {"pylint": "--output-format=json", "eslint": "--format=json"}[tool]

    def one(name: str, content: str) -> list[tuple[int, str, str, str]]:
        with tempfile.TemporaryDirectory() as folder:
            place = os.path.join(folder, name)
            with open(place, "w", encoding="utf-8", newline="") as out:
                out.write(content)
            try:
                return parse(tool, subprocess.run([tool, option, place], capture_output=True, text=True, timeout=TIMEOUT).stdout)
            except (OSError, subprocess.SubprocessError, ValueError, AttributeError, TypeError):
                return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shutil.which(tool)
        for batch in batches:
            rows = [(path, *m) for path, name, content in zip(*[c.to_pylist() for c in batch.columns]) if there for m in one(name, content or "")]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["path", "line_no", "severity", "title", "suggestion"])

    return files.where(F.col("suffix").isin(*suffixes)).select("path", "file_name", "content").mapInArrow(run, ISSUES)
