"""The gate: static analysis, security scan and layer rules, and whether their findings block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators.findings import count_of, keep_first, numbered
from ..operators.match import match
from ..operators.rules import catalogue, rules
from ..operators.syntax import dangerous_calls, syntax_nodes
from ..sources.files import lines, scan, scanned_paths

SEVERITIES = ("P0", "P1", "P2")
CHECKS = ("static_analysis", "security_scan", "arch_compliance")
ISSUE = ("id", "category", "severity", "rule_id", "title", "path", "line_no", "owasp", "suggestion", "snippet")


def described(found: DataFrame) -> DataFrame:
    """found (rule_id, ...) with the catalogue's facts."""
    facts = catalogue(found.sparkSession).withColumnRenamed("advice", "suggestion")
    return found.join(F.broadcast(facts), "rule_id")  # the catalogue has a fixed number of rows


def pattern_rows(source_lines: DataFrame, *prefixes: str) -> DataFrame:
    """Matches of the rules with these prefixes, described, with seq and snippet."""
    found = match(source_lines, rules(*prefixes)).withColumn("snippet", snippet(F.col("line"))).withColumn("seq", F.lit(0))
    return described(found.select("path", "line_no", "rule_id", "snippet", "seq"))


def static_rows(source_lines: DataFrame) -> DataFrame:
    """Issues of lines of the static scan, without numbers: all that counts need."""
    return pattern_rows(source_lines, "SA-").withColumn("category", F.lit("static_analysis"))


def static_issues(source_lines: DataFrame) -> DataFrame:
    """Issues of lines of the static scan; Python files come before script files."""
    return numbered(static_rows(source_lines), "SA-%03d", "phase").select(*ISSUE)


def security_patterns(source_lines: DataFrame) -> DataFrame:
    return pattern_rows(source_lines, "SEC-RX")


def security_calls(nodes: DataFrame) -> DataFrame:
    """Dangerous calls among syntax nodes; the snippet names the line."""
    calls = dangerous_calls(nodes).select("path", "line_no", "seq", "rule_id", F.format_string("line %d", "line_no").alias("snippet"))
    return described(calls)


def first_issues(rows: DataFrame) -> DataFrame:
    """One issue for each file, line and rule."""
    return keep_first(rows, "path", "line_no", "rule_id")


def security_rows(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Issues of files of the security scan, without numbers.  ``nodes``: syntax nodes of at least these files, if they are parsed already."""
    own = scan(files, "security")
    calls = security_calls(syntax_nodes(own) if nodes is None else scanned_paths(nodes, "security"))
    return first_issues(calls.unionByName(security_patterns(lines(own)))).withColumn("category", F.lit("security"))


def security_issues(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Issues of files of the security scan: calls, then patterns, of each file."""
    return numbered(security_rows(files, nodes), "SEC-%03d").select(*ISSUE)


def missing_directory(spark: SparkSession, check: str, root: str) -> DataFrame:
    """The issue of a check whose folder isn't there."""
    return spark.createDataFrame([("MISSING-DIR", check, "P0", "MISSING-DIR", "folder not found", root, None, None, None, None)], "id string, category string, severity string, rule_id string, title string, path string, line_no int, owasp string, suggestion string, snippet string")


def all_issues(checks: dict[str, DataFrame]) -> DataFrame:
    """The issues of all checks, with the name of the check."""
    out = None
    for name, issues in checks.items():
        part = issues.withColumn("check", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def summary(issues: DataFrame, force: bool = False) -> DataFrame:
    """One row: counts by severity, and whether the gate blocks, passes, or is passed by force."""
    counts = issues.agg(F.count("*").alias("total_issues"), *[count_of(F.col("severity"), s).alias(a) for s, a in zip(SEVERITIES, ("p0_blockers", "p1_warnings", "p2_suggestions"))])
    blocked = (F.col("p0_blockers") > 0) & F.lit(not force)
    return counts.withColumn("blocked", blocked).withColumn("passed", ~F.col("blocked")).withColumn("force_bypass", (F.col("p0_blockers") > 0) & F.lit(force))


def check_passed(issues: DataFrame) -> DataFrame:
    """One row: whether a check has no P0 issue."""
    return issues.agg((~F.coalesce(F.bool_or(F.col("severity") == "P0"), F.lit(False))).alias("passed"))


def tools_used(files: DataFrame) -> DataFrame:
    """One row: the built-in checks that files of their kind call for, joined."""
    python, script = F.bool_or(F.col("suffix") == ".py"), F.bool_or(F.col("suffix").isin(".js", ".ts"))
    return files.agg(F.concat_ws(", ", F.when(python, "builtin-python"), F.when(script, "builtin-script")).alias("tools"))


def report(checks: dict[str, DataFrame], code_path: str, force: bool = False) -> DataFrame:
    """One row: code_path, passed by check, and the summary.  The issues stay a table of their own."""
    issues = all_issues(checks)
    by_check = issues.groupBy("check").agg(count_of(F.col("severity"), "P0").alias("p0"))
    names = F.map_from_entries(F.collect_list(F.struct("check", (F.col("p0") == 0).alias("ok"))))
    found = by_check.agg(names.alias("found"))
    every = F.map_from_arrays(F.array(*[F.lit(c) for c in checks]), F.array(*[F.coalesce(F.try_element_at("found", F.lit(c)), F.lit(True)) for c in checks]))
    return found.select(F.lit(code_path).alias("code_path"), every.alias("checks")).crossJoin(summary(issues, force))  # one row each


def crosstab(issues: DataFrame) -> DataFrame:
    """Issues by check and severity, with a row of totals whose check is null."""
    return issues.rollup("check").agg(F.count("*").alias("total"), *[count_of(F.col("severity"), s).alias(s.lower()) for s in SEVERITIES])


def top_blockers(issues: DataFrame, most: int = 10) -> DataFrame:
    """The first P0 issues in order of check and number."""
    return issues.where("severity = 'P0'").orderBy("check", "id").limit(most).select("check", "id", "rule_id", "path", "line_no")
