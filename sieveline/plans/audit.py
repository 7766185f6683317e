"""The audit: findings, histogram, risk score, remediation plan, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitise, snippet
from ..operators.findings import count_of, keep_first, numbered
from ..operators.match import unprotected_routes
from ..operators.syntax import secret_assignments, syntax_nodes
from ..sources.files import lines, scan, scanned_paths
from .gate import described, pattern_rows

LEVELS = ("critical", "high", "medium", "low", "info")
#: What a finding of each level adds to the risk score, and the most it can reach.
WEIGHTS = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 1.0, "info": 0.2}
MOST_RISK = 100.0
TOOL = "sieveline audit 1.0"
#: Our own words for the plan: level -> (priority, what to do, by when).
PLAN = {"critical": (1, "fix %d critical findings at once", "24 hours"), "high": (2, "fix %d high findings soon", "this week"), "medium": (3, "plan fixes for %d medium findings", "next iteration")}
FINDING = ("id", "rule_id", "path", "line_no", "title", "severity", "owasp", "cwe", "snippet", "recommendation", "confidence")


def confidence():
    return F.when(F.col("severity").isin("critical", "high"), "high").otherwise("medium")


def audit_patterns(source_lines: DataFrame) -> DataFrame:
    return pattern_rows(source_lines, "AUD-").withColumn("target", F.lit(""))


def access_control(source_lines: DataFrame) -> DataFrame:
    rows = unprotected_routes(source_lines).withColumn("snippet", snippet(F.col("line"))).withColumn("seq", F.lit(0))
    return described(rows.select("path", "line_no", "rule_id", "snippet", "seq")).withColumn("target", F.lit(""))


def secrets_in_code(nodes: DataFrame) -> DataFrame:
    """Secret assignments among syntax nodes; title and advice have the name."""
    rows = described(secret_assignments(nodes).withColumnRenamed("name", "target"))
    named = lambda c: F.replace(c, F.lit("%s"), F.col("target"))
    return rows.withColumn("title", named("title")).withColumn("suggestion", named("suggestion"))


def first_findings(rows: DataFrame) -> DataFrame:
    """One finding for each file, line, rule and named target."""
    return keep_first(rows, "path", "line_no", "rule_id", "target")


def finished(rows: DataFrame) -> DataFrame:
    """Numbered findings."""
    return numbered(rows, "AUDIT-%04d").withColumn("confidence", confidence()).withColumnRenamed("suggestion", "recommendation").select(*FINDING)


def line_rows(source_lines: DataFrame) -> DataFrame:
    """Findings that lines alone show, each once, without numbers: all that counts and scores need."""
    return first_findings(audit_patterns(source_lines).unionByName(access_control(source_lines)))


def line_findings(source_lines: DataFrame) -> DataFrame:
    return finished(line_rows(source_lines))


def rows(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All findings of files, each once, without numbers.  ``nodes``: syntax nodes of at least these files, if they are parsed already."""
    own = scan(files, "audit")
    source_lines = lines(own)
    named = secrets_in_code(syntax_nodes(own) if nodes is None else scanned_paths(nodes, "audit"))
    return first_findings(audit_patterns(source_lines).unionByName(access_control(source_lines)).unionByName(named))


def findings(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All findings of files."""
    return finished(rows(files, nodes))


def histogram(found: DataFrame) -> DataFrame:
    """One row: findings of each level, 0 where there are none, and all of them."""
    return found.agg(*[count_of(F.col("severity"), s).alias(s) for s in LEVELS], F.count("*").alias("total_findings"))


def risk_score(found: DataFrame) -> DataFrame:
    """One row: the weighted number of findings, at most MOST_RISK, to one decimal."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    total = F.coalesce(F.sum(weight[F.col("severity")]), F.lit(0.0))
    return found.agg(F.bround(F.least(total, F.lit(MOST_RISK)), 1).alias("risk_score"))


def owasp_covered(found: DataFrame) -> DataFrame:
    """One row: the distinct categories in order."""
    return found.agg(F.array_sort(F.collect_set(F.when(F.col("owasp") != "", F.col("owasp")))).alias("owasp_covered"))


def owasp_counts(found: DataFrame) -> DataFrame:
    """Findings by category, most first, then in order of first appearance."""
    return found.groupBy("owasp").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id")


def remediation(found: DataFrame) -> DataFrame:
    """A row for each level of the plan with findings; ``findings`` has their ids in order.

    The list of ids is part of the report; ``remediation_counts`` has the plan
    without it for corpora of any size.
    """
    grouped = found.where(F.col("severity").isin(*PLAN)).groupBy("severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("findings"))
    return _planned(grouped).select("priority", "severity", "action", "findings", "deadline")


def remediation_counts(found: DataFrame) -> DataFrame:
    return _planned(found.where(F.col("severity").isin(*PLAN)).groupBy("severity").agg(F.count("*").alias("n"))).select("priority", "severity", "action", "deadline")


def _planned(grouped: DataFrame) -> DataFrame:
    get = lambda i: F.create_map(*[F.lit(x) for k, v in PLAN.items() for x in (k, v[i])])[F.col("severity")]
    action = F.coalesce(*[F.when(F.col("severity") == k, F.format_string(v[1], "n")) for k, v in PLAN.items()])
    return grouped.withColumn("priority", get(0)).withColumn("action", action).withColumn("deadline", get(2))


def severity_share(found: DataFrame) -> DataFrame:
    """Level, count and share of the levels with findings; shares are whole percents, ties to even."""
    counts = found.groupBy("severity").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.concat(F.bround(F.col("n") * 100 / F.col("total"), 0).cast("int").cast("string"), F.lit("%"))
    return counts.crossJoin(total).select("severity", "n", share.alias("share"))  # LEVELS rows and one row


def report(found: DataFrame, files_scanned: DataFrame, folder: str = "") -> DataFrame:
    """One row: when, of which folder and by what tool, files_scanned, the histogram, the risk score and the categories.

    The findings, and the plan by level, stay tables of their own.
    """
    counts = files_scanned.crossJoin(histogram(found)).crossJoin(risk_score(found)).crossJoin(owasp_covered(found))  # one row each
    when = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return counts.select(when.alias("timestamp"), F.lit(folder).alias("code_directory"), F.lit(TOOL).alias("tool"), "*")


def annotations(found: DataFrame) -> DataFrame:
    """Lines for a CI system: one for each finding and one for its advice."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning")
    title, path, advice = sanitise(F.col("title")), sanitise(F.col("path")), sanitise(F.col("recommendation"))
    line = F.coalesce(F.col("line_no"), F.lit(1))
    first = F.format_string("::%s file=%s,line=%d,title=%s::%s", level, path, line, title, title)
    second = F.when(advice != "", F.format_string("::notice file=%s,line=%d::Suggestion: %s", path, line, advice))
    both = F.filter(F.array(first, second), lambda x: x.isNotNull())
    return found.select("id", F.posexplode(both).alias("part", "message"))


def ci_summary(found: DataFrame) -> DataFrame:
    """One row: critical, high, total, and the exit code."""
    counts = found.agg(count_of(F.col("severity"), "critical").alias("critical"), count_of(F.col("severity"), "high").alias("high"), F.count("*").alias("total"))
    return counts.withColumn("exit_code", (F.col("critical") > 0).cast("int"))
