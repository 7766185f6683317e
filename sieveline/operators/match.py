"""All rules over all lines in one pass."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pattern
from .rules import Rule

#: What a comment line begins with.
COMMENTS = ("#", "//", "*", '"""', "'''")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def begins(*marks: str) -> Column:
    """Lines that begin with one of the marks, after white space."""
    return F.col("line").rlike(r"(?U)^[\s\x1c-\x1f]*(" + "|".join(r"\Q" + m + r"\E" for m in marks) + ")")


def guarded(rule: Rule) -> Column | None:
    """Holds where the rule is not to report.  Only asked of lines that the pattern matches."""
    line = F.col("line")
    if rule.guard == "hash":
        return begins("#")
    if rule.guard == "comment":
        return begins(*COMMENTS)
    if rule.guard == "secret":
        return begins("#", "//") | F.contains(F.lower("file_name"), F.lit("example"))
    if rule.guard == "raw":
        return F.contains(line, F.lit('r"')) | F.contains(line, F.lit("r'"))
    if rule.guard == "not-api":
        return ~F.contains(F.lower(line), F.lit("api"))
    return None


def holds(rule: Rule) -> Column:
    condition = F.col("suffix").isin(*rule.suffixes)
    if rule.needs:
        condition = condition & any_of(F.contains(F.col("_folded"), F.lit(n)) for n in rule.needs)
    condition = condition & F.col("line").rlike(pattern(rule.regex, rule.ignore_case))
    guard = guarded(rule)
    return condition if guard is None else condition & ~guard


def match(lines: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """lines (path, file_name, suffix, line_no, line) with a row for each rule that reports the line, and its rule_id.

    The rules are one array of literals-or-null in the projection of the scan,
    so any number of them is a single pass without a join or a shuffle.
    """
    rules = list(rules)
    if not rules:
        return lines.withColumn("rule_id", F.lit("")).limit(0)
    found = F.filter(F.array(*[F.when(holds(r), F.lit(r.rule_id)) for r in rules]), lambda x: x.isNotNull())
    prepared = lines.where(F.col("suffix").isin(*sorted({s for r in rules for s in r.suffixes})))
    # s and its long form are one letter to patterns that ignore case.
    prepared = prepared.withColumn("_folded", F.replace(F.lower("line"), F.lit("ſ"), F.lit("s")))
    literals = {n for r in rules for n in r.needs}
    if all(r.needs for r in rules):
        # Most lines have none of the literals, and no rule is tried on them.
        apart = sorted(n for n in literals if not any(o != n and o in n for o in literals))
        found = F.when(any_of(F.contains("_folded", F.lit(n)) for n in apart), found)
    return prepared.withColumn("rule_id", F.explode(found)).drop("_folded")


def unprotected_routes(lines: DataFrame) -> DataFrame:
    """Route lines of Python files in which nothing asks for a login or permission; rule_id AUD-ACC-1.

    Two aggregates over a file decide; the lines themselves are only read again
    for the files that have routes.
    """
    from .rules import PROTECTED, ROUTES

    python = lines.where(F.col("suffix") == ".py")
    route = any_of(F.contains("line", F.lit(r)) for r in ROUTES)
    safe = any_of(F.contains("line", F.lit(p)) for p in PROTECTED)
    marked = python.where(route | safe).withColumn("_route", route).withColumn("_safe", safe)
    open_files = marked.groupBy("path").agg(F.bool_or("_safe").alias("_any")).where(~F.col("_any")).select("path")
    return marked.where("_route").drop("_route", "_safe").join(open_files, "path", "left_semi").withColumn("rule_id", F.lit("AUD-ACC-1")).select(*lines.columns, "rule_id")
