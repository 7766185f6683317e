"""The queries of the library: name -> (spark, sf_dir) -> DataFrame, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import hash12, shorten
from .operators import documents, freeze, layers
from .operators.match import match
from .operators.rules import EXCLUDED, PROTECTED, ROUTES, SUFFIXES, catalogue, facts, rules
from .operators.syntax import imports, parsed, syntax_nodes
from .plans import arch, audit, gate
from .plans.planted import ARCH_SQL, LAYERS, PLANTED_SQL, arch_edges, arch_files, design_json, listed, pick, planted_files, planted_lines, quoted, statement_files, table
from .sources.files import files_from_dir, files_from_table, lines, scan
from .sources.kept import Workspace
from .sources.linters import ESLINT_LEVELS, PYLINT_LEVELS, level
from .sources.spread import spread
from .sources.trace import last_per_step, make_records, read_trace
from .sources.workspace import append_json_lines, as_json_lines, read_context_files, read_document, write_document, write_generated

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql.strip()
        return f

    return add


# SQL building blocks: the rules evaluated by DuckDB's own engine.


def _stripped() -> str:
    return "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def rule_sql(rule) -> str:
    """A condition on suffix, file_name and line.  RE2 has no lookahead, so two patterns are restated."""
    if rule.rule_id == "SA-JS-3":
        found = "contains(line, '==')"
    elif rule.rule_id == "AUD-SEN-5":
        found = r"contains(regexp_replace(line, 'http://(localhost|127\.0\.0\.1)', ' ', 'g'), 'http://')"
    else:
        found = f"regexp_matches(line, {quoted(rule.regex)}, '{'i' if rule.ignore_case else 'c'}')"
    guard = {
        "": "",
        "hash": f" AND NOT starts_with({_stripped()}, '#')",
        "comment": "".join(f" AND NOT starts_with({_stripped()}, {quoted(c)})" for c in ("#", "//", "*", '"""', "'''")),
        "secret": f" AND NOT starts_with({_stripped()}, '#') AND NOT starts_with({_stripped()}, '//') AND NOT contains(lower(file_name), 'example')",
        "raw": " AND NOT contains(line, 'r\"') AND NOT contains(line, 'r''')",
        "not-api": " AND contains(lower(line), 'api')",
    }[rule.guard]
    return f"suffix IN ({listed(rule.suffixes)}) AND {found}{guard}"


def matches_sql(prefix: str | tuple[str, ...], source: str = "planted") -> str:
    own = rules(*([prefix] if isinstance(prefix, str) else prefix))
    return " UNION ALL ".join(f"SELECT path, file_name, suffix, line_no, line, {quoted(r.rule_id)} AS rule_id FROM {source} WHERE {rule_sql(r)}" for r in own)


def scan_sql(check: str, source: str = "planted") -> str:
    return f"SELECT * FROM {source} WHERE suffix IN ({listed(SUFFIXES[check])}) AND NOT list_has_any(string_split(path, '/'), [{listed(EXCLUDED[check])}])"


FACTS_SQL = "facts(rule_id, severity, ordinal, phase, owasp, cwe) AS (VALUES " + ", ".join(f"({quoted(r)}, {quoted(s)}, {o}, {p}, {quoted(w)}, {quoted(c)})" for r, s, o, p, w, c, _, _ in facts()) + ")"
SNIPPET_SQL = f"substring({_stripped()}, 1, 120)"
ROUTES_SQL = """routes AS (
  SELECT path, file_name, suffix, line_no, line, 'AUD-ACC-1' AS rule_id FROM (
    SELECT *, bool_or({safe}) OVER (PARTITION BY path) AS any_safe FROM scanned WHERE suffix = '.py')
  WHERE NOT any_safe AND ({route}))""".format(safe=" OR ".join(f"contains(line, {quoted(p)})" for p in PROTECTED), route=" OR ".join(f"contains(line, {quoted(p)})" for p in ROUTES))
NUMBER = "row_number() OVER (ORDER BY regexp_replace(path, '/[^/]*$', ''), path, phase, ordinal, line_no)"
AUDIT_SQL = f"""WITH {PLANTED_SQL}, {FACTS_SQL}, scanned AS ({scan_sql('audit')}), {ROUTES_SQL},
matched AS ({matches_sql('AUD-', 'scanned')} UNION ALL SELECT * FROM routes),
found AS (SELECT printf('AUDIT-%04d', {NUMBER}) AS id, m.*, severity, owasp, cwe FROM matched m JOIN facts USING (rule_id))"""
GATE_SQL = f"""WITH {PLANTED_SQL}, {FACTS_SQL},
st AS ({scan_sql('static')}), se AS ({scan_sql('security')}),
matched AS (SELECT 'static_analysis' AS "check", * FROM ({matches_sql('SA-', 'st')}) UNION ALL SELECT 'security_scan', * FROM ({matches_sql('SEC-RX', 'se')})),
issues AS (SELECT m.*, severity, phase, ordinal FROM matched m JOIN facts USING (rule_id))"""
SA_ID = "printf('SA-%03d', row_number() OVER (ORDER BY phase, regexp_replace(path, '/[^/]*$', ''), path, ordinal, line_no))"


# Scans and lines.


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("doc/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return files_from_table(spread(table(spark, sf_dir, "documents")), path, F.col("text"))


DOC_LINES_SQL = """dlines AS (
  SELECT 'doc/' || lang || '/' || source || '/' || doc_id::VARCHAR || '.py' AS path, doc_id::VARCHAR || '.py' AS file_name, '.py' AS suffix, u.i::INT AS line_no, u.line
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY u(line, i))"""


@query(f"WITH {DOC_LINES_SQL} SELECT path, line_no, line FROM dlines")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_documents(spark, sf_dir)).select("path", "line_no", "line")


def _scan_query(check: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan(planted_files(spark, sf_dir), check).select("path", "suffix")

    query(f"WITH {PLANTED_SQL} SELECT DISTINCT path, suffix FROM ({scan_sql(check)})", f"source_scan_{check}")(run)


for _check in SUFFIXES:
    _scan_query(_check)


@query(f"WITH {PLANTED_SQL} SELECT " + ", ".join(f"(SELECT count(DISTINCT path) FROM ({scan_sql(c)})) AS {c}" for c in SUFFIXES))
def files_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = planted_files(spark, sf_dir)
    kept = {c: F.col("suffix").isin(*SUFFIXES[c]) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED[c]])) for c in SUFFIXES}
    return files.agg(*[F.count_if(k).alias(c) for c, k in kept.items()])


# Static analysis and security patterns.


def _own(spark: SparkSession, sf_dir: str, check: str) -> DataFrame:
    return scan(planted_lines(spark, sf_dir), check)


@query(f"WITH {PLANTED_SQL}, st AS ({scan_sql('static')}) SELECT path, line_no, rule_id, {SNIPPET_SQL} AS snippet FROM ({matches_sql('SA-PY', 'st')})")
def static_py_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.pattern_rows(_own(spark, sf_dir, "static"), "SA-PY").select("path", "line_no", "rule_id", "snippet")


PAGE_LINES_SQL = """plines AS (
  SELECT 'web/' || page_id::VARCHAR || '.js' AS path, page_id::VARCHAR || '.js' AS file_name, '.js' AS suffix, u.i::INT AS line_no, u.line
  FROM pages, unnest(string_split(html, chr(10))) WITH ORDINALITY u(line, i))"""


@query(f"WITH {PAGE_LINES_SQL} SELECT path, line_no, rule_id FROM ({matches_sql('SA-JS', 'plines')})")
def static_js_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".js"))
    pages = files_from_table(spread(table(spark, sf_dir, "pages")), path, F.col("html"))
    return match(lines(pages), rules("SA-JS")).select("path", "line_no", "rule_id")


@query(f"WITH {PLANTED_SQL}, {FACTS_SQL}, st AS ({scan_sql('static')}) SELECT {SA_ID} AS id, path, line_no, rule_id, severity FROM ({matches_sql('SA-', 'st')}) JOIN facts USING (rule_id)")
def static_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.static_issues(_own(spark, sf_dir, "static")).select("id", "path", "line_no", "rule_id", "severity")


@query(f"WITH {PLANTED_SQL}, {FACTS_SQL}, se AS ({scan_sql('security')}) SELECT path, line_no, rule_id, severity, owasp, {SNIPPET_SQL} AS snippet FROM ({matches_sql('SEC-RX', 'se')}) JOIN facts USING (rule_id)")
def security_pattern_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.security_patterns(_own(spark, sf_dir, "security")).select("path", "line_no", "rule_id", "severity", "owasp", "snippet")


@query(f"WITH {DOC_LINES_SQL}, {FACTS_SQL} SELECT path, line_no, rule_id, severity FROM ({matches_sql('SEC-RX', 'dlines')}) JOIN facts USING (rule_id)")
def security_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.security_patterns(lines(_documents(spark, sf_dir))).select("path", "line_no", "rule_id", "severity")


@query(f"WITH {DOC_LINES_SQL} SELECT rule_id, count(*) AS n FROM ({matches_sql(tuple(r.rule_id for r in rules('SA', 'SEC', 'AUD')), 'dlines')}) GROUP BY rule_id")
def all_rules_over_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by rule of all 55 patterns over every line of documents."""
    return match(lines(_documents(spark, sf_dir)), rules("SA", "SEC", "AUD")).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"WITH {PLANTED_SQL}, {FACTS_SQL}, se AS ({scan_sql('security')}), twice AS (SELECT * FROM se UNION ALL SELECT * FROM se) SELECT path, line_no, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY path, line_no, rule_id) AS k FROM ({matches_sql('SEC-RX', 'twice')})) WHERE k = 1")
def security_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _own(spark, sf_dir, "security")
    return gate.first_issues(gate.security_patterns(own.unionAll(own))).select("path", "line_no", "rule_id")


# Syntax trees.  What each planted statement must give is stated here by hand, so SQL need not parse.

STATED = """stated(k, place, rule_id, severity, snippet) AS (VALUES
 (1, 0, 'SEC-AST-1', 'P0', 'line 1'), (2, 0, 'SEC-AST-1', 'P0', 'line 1'), (3, 0, 'SEC-AST-2', 'P0', 'line 1'), (5, 0, 'SEC-AST-1', 'P0', 'line 1'), (15, 0, 'SEC-AST-3', 'P1', 'line 1'),
 (16, 0, 'SEC-AST-4', 'P0', 'line 1'), (17, 0, 'SEC-RX-4', 'P0', 'API_KEY = token = "0123456789"'), (19, 0, 'SEC-AST-1', 'P0', 'line 1'),
 (3, 0, 'AUD-DES-1', 'critical', 'a.b().pickle.loads(z)'), (7, 0, 'AUD-SEN-1', 'critical', 'db_password = "abcde"'), (7, 1, 'AUD-AST-1', 'critical', 'db_password = \'\'***\'\''),
 (8, 0, 'AUD-SEN-1', 'critical', 'db_password = "abcd"'), (16, 0, 'AUD-DES-4', 'critical', 'yaml.load(s, Loader=L)'), (17, 0, 'AUD-SEN-3', 'critical', 'API_KEY = token = "0123456789"'),
 (17, 1, 'AUD-AST-1', 'critical', 'API_KEY = \'\'***\'\''), (17, 2, 'AUD-AST-1', 'critical', 'token = \'\'***\'\'')),
given AS (SELECT 'ast/' || event_id::VARCHAR || '.py' AS path, 1 AS line_no, stated.* FROM events JOIN stated ON event_id % 20 = k)"""


@query(f"WITH {STATED} SELECT printf('SEC-%03d', row_number() OVER (ORDER BY path, place)) AS id, path, line_no, rule_id, severity, snippet FROM given WHERE rule_id LIKE 'SEC%'")
def security_ast_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.security_issues(statement_files(spark, sf_dir)).select("id", "path", "line_no", "rule_id", "severity", "snippet")


@query(f"WITH {STATED} SELECT path, line_no, string_split(snippet, ' ')[1] AS name, snippet, 'hard-coded secret: ' || string_split(snippet, ' ')[1] AS title FROM given WHERE rule_id = 'AUD-AST-1'")
def ast_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.secrets_in_code(syntax_nodes(statement_files(spark, sf_dir))).select("path", "line_no", F.col("target").alias("name"), "snippet", "title")


@query("WITH stated(k, seq, module) AS (VALUES (6, 0, 'pickle'), (12, 0, 'a'), (13, 0, 'a.b'), (13, 1, 'c')) SELECT 'ast/' || event_id::VARCHAR || '.py' AS path, seq, module FROM events JOIN stated ON event_id % 20 = k")
def ast_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports(syntax_nodes(statement_files(spark, sf_dir)))


# Audit.

AUDIT_GROUPS = {
    "audit_injection": ("AUD-INJ",), "audit_secrets": ("AUD-SEN-1", "AUD-SEN-2", "AUD-SEN-3", "AUD-SEN-4"), "audit_http": ("AUD-SEN-5",), "audit_xss": ("AUD-XSS",),
    "audit_deserialisation": ("AUD-DES",), "audit_logging": ("AUD-LOG",), "audit_traversal": ("AUD-PTH",), "audit_crypto": ("AUD-CRY",),
}


def _audit_query(name: str, prefixes: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gate.pattern_rows(_own(spark, sf_dir, "audit"), *prefixes).select("path", "line_no", "rule_id", "severity", "cwe", "snippet")

    query(f"WITH {PLANTED_SQL}, {FACTS_SQL}, au AS ({scan_sql('audit')}) SELECT path, line_no, rule_id, severity, cwe, {SNIPPET_SQL} AS snippet FROM ({matches_sql(prefixes, 'au')}) JOIN facts USING (rule_id)", name)(run)


for _name, _prefixes in AUDIT_GROUPS.items():
    _audit_query(_name, _prefixes)


@query(f"WITH {PLANTED_SQL}, scanned AS ({scan_sql('audit')}), {ROUTES_SQL} SELECT path, line_no, rule_id, {SNIPPET_SQL} AS snippet FROM routes")
def audit_access_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.access_control(_own(spark, sf_dir, "audit")).select("path", "line_no", "rule_id", "snippet")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.line_findings(_own(spark, sf_dir, "audit"))


def _finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without numbers, for counts."""
    return audit.line_rows(_own(spark, sf_dir, "audit"))


@query(f"{AUDIT_SQL} SELECT id, path, line_no, rule_id, severity, owasp, cwe, CASE WHEN severity IN ('critical', 'high') THEN 'high' ELSE 'medium' END AS confidence FROM found")
def audit_findings_dedup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("id", "path", "line_no", "rule_id", "severity", "owasp", "cwe", "confidence")


@query(f"{AUDIT_SQL} SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in audit.LEVELS) + ", count(*) AS total_findings FROM found")
def audit_severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histogram(_finding_rows(spark, sf_dir))


@query(f"{AUDIT_SQL} SELECT round_even(least(coalesce(sum(CASE severity " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in audit.WEIGHTS.items()) + " END), 0), 100.0::DOUBLE), 1) AS risk_score FROM found")
def audit_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.risk_score(_finding_rows(spark, sf_dir))


@query(f"{AUDIT_SQL} SELECT list_sort(list(DISTINCT owasp) FILTER (owasp != '')) AS owasp_covered FROM found")
def audit_owasp_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.owasp_covered(_finding_rows(spark, sf_dir))


_PLAN_SQL = "plan(priority, severity, words, deadline) AS (VALUES " + ", ".join(f"({p}, {quoted(s)}, {quoted(w)}, {quoted(d)})" for s, (p, w, d) in audit.PLAN.items()) + ")"


@query(f"{AUDIT_SQL}, {_PLAN_SQL} SELECT priority, severity, printf(any_value(words), count(*)) AS action, list_sort(list(id)) AS findings, any_value(deadline) AS deadline FROM found JOIN plan USING (severity) GROUP BY priority, severity")
def audit_remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.remediation(_findings(spark, sf_dir))


@query(f"{AUDIT_SQL} SELECT severity, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM found), 0)::INT::VARCHAR || '%' AS share FROM found GROUP BY severity")
def severity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.severity_share(_finding_rows(spark, sf_dir))


@query(f"{AUDIT_SQL} SELECT owasp, count(*) AS n, min(id) AS first_id FROM found GROUP BY owasp")
def owasp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.owasp_counts(_findings(spark, sf_dir))


_WORDS_SQL = "words(rule_id, title, advice) AS (VALUES " + ", ".join(f"({quoted(f[0])}, {quoted(f[6])}, {quoted(f[7])})" for f in facts()) + ")"


@query(
    f"{AUDIT_SQL}, {_WORDS_SQL} SELECT id, 0 AS part, printf('::%s file=%s,line=%d,title=%s::%s', CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END, path, line_no, title, title) AS message FROM found JOIN words USING (rule_id)"
    " UNION ALL SELECT id, 1, printf('::notice file=%s,line=%d::Suggestion: %s', path, line_no, advice) FROM found JOIN words USING (rule_id)"
)
def ci_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.annotations(_findings(spark, sf_dir))


@query(f"{AUDIT_SQL} SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) AS total, (count(*) FILTER (severity = 'critical') > 0)::INT AS exit_code FROM found")
def ci_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ci_summary(_finding_rows(spark, sf_dir))


@query(f"WITH {STATED} SELECT printf('AUDIT-%04d', row_number() OVER (ORDER BY path, place)) AS id, path, line_no, rule_id, severity, snippet FROM given WHERE rule_id LIKE 'AUD%'")
def audit_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of files, syntax trees included."""
    return audit.findings(statement_files(spark, sf_dir)).select("id", "path", "line_no", "rule_id", "severity", "snippet")


# The gate.


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = planted_lines(spark, sf_dir)
    security = gate.numbered(_security_rows(planted), "SEC-%03d").select(*gate.ISSUE)
    return gate.all_issues({"static_analysis": gate.static_issues(scan(planted, "static")), "security_scan": security})


def _security_rows(planted: DataFrame) -> DataFrame:
    return gate.first_issues(gate.security_patterns(scan(planted, "security"))).withColumn("category", F.lit("security"))


def _issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without numbers, for counts."""
    planted = planted_lines(spark, sf_dir)
    return gate.all_issues({"static_analysis": gate.static_rows(scan(planted, "static")), "security_scan": _security_rows(planted)})


_COUNTS = "count(*) AS total_issues, count(*) FILTER (severity = 'P0') AS p0_blockers, count(*) FILTER (severity = 'P1') AS p1_warnings, count(*) FILTER (severity = 'P2') AS p2_suggestions"


@query(f"{GATE_SQL} SELECT {_COUNTS}, count(*) FILTER (severity = 'P0') > 0 AS blocked, count(*) FILTER (severity = 'P0') = 0 AS passed, false AS force_bypass FROM issues")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.summary(_issue_rows(spark, sf_dir))


@query(f"{GATE_SQL} SELECT {_COUNTS}, false AS blocked, true AS passed, count(*) FILTER (severity = 'P0') > 0 AS force_bypass FROM issues")
def gate_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.summary(_issue_rows(spark, sf_dir), force=True)


@query(f'{GATE_SQL} SELECT "check", count(*) AS total, ' + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in gate.SEVERITIES) + ' FROM issues GROUP BY ROLLUP ("check")')
def gate_crosstab_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.crosstab(_issue_rows(spark, sf_dir))


@query(
    f"{GATE_SQL}, ids AS (SELECT *, printf('SEC-%03d', {NUMBER}) AS id FROM issues WHERE \"check\" = 'security_scan')"
    " SELECT \"check\", id, rule_id, path, line_no FROM ids WHERE severity = 'P0' ORDER BY \"check\", id LIMIT 10"
)
def gate_top10_p0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.top_blockers(_issues(spark, sf_dir))


@query(f"{GATE_SQL} SELECT \"check\", count(*) FILTER (severity = 'P0') = 0 AS passed FROM issues GROUP BY \"check\"")
def gate_checks_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_rows(spark, sf_dir).groupBy("check").agg((F.count_if(F.col("severity") == "P0") == 0).alias("passed"))


@query(f"""WITH {STATED}, own AS (SELECT * FROM given WHERE rule_id LIKE 'SEC%')
SELECT 'ast' AS code_path, true AS static_analysis, count(*) FILTER (severity = 'P0') = 0 AS security_scan, true AS arch_compliance, count(*) AS total_issues, count(*) FILTER (severity = 'P0') AS p0_blockers,
count(*) FILTER (severity = 'P1') AS p1_warnings, 0::BIGINT AS p2_suggestions, count(*) FILTER (severity = 'P0') > 0 AS blocked, count(*) FILTER (severity = 'P0') = 0 AS passed, false AS force_bypass FROM own""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole gate over files of one statement, with the planted design, from one parse."""
    files = statement_files(spark, sf_dir)
    nodes = parsed(files)
    designs = spark.createDataFrame([(design_json(),)], "json string")
    checks = {"static_analysis": gate.static_rows(lines(scan(files, "static"))), "security_scan": gate.security_rows(files, nodes), "arch_compliance": arch.arch_issues(files, designs, nodes)}
    report = gate.report(checks, "ast")
    return report.select("code_path", *[F.col("checks")[c].alias(c) for c in checks], *[c for c in report.columns if c not in ("code_path", "checks")])


@query(
    """SELECT unnest(string_split(ids, ' ')) AS rule_id, severity, owasp, cwe FROM (VALUES
    ('SA-PY-1', 'P1', '', ''), ('SA-PY-2 SA-PY-3 SA-PY-4 SA-PY-5 SA-PY-6 SA-PY-7 SA-JS-1 SA-JS-2 SA-JS-3', 'P2', '', ''),
    ('SEC-RX-1 SEC-RX-2 SEC-RX-3 SEC-RX-8', 'P0', 'A03:2021 – Injection', ''), ('SEC-RX-4', 'P0', 'A07:2021 – 身份识别和身份验证失败', ''), ('SEC-RX-5', 'P0', 'A07:2021', ''),
    ('SEC-RX-6', 'P0', 'A03:2021 – Injection (XSS)', ''), ('SEC-RX-7', 'P1', 'A03:2021', ''), ('SEC-RX-9', 'P0', 'A01:2021', ''), ('SEC-RX-10', 'P1', 'A09:2021 – 安全日志记录和监控故障', ''), ('SEC-RX-11', 'P2', 'A02:2021 – 加密机制失效', ''),
    ('SEC-AST-1', 'P0', 'A03:2021 – Injection', ''), ('SEC-AST-2', 'P0', 'A08:2021 – 软件和数据完整性故障', ''), ('SEC-AST-3', 'P1', 'A03:2021 – Injection', ''), ('SEC-AST-4', 'P0', 'A08:2021', ''),
    ('AUD-INJ-1 AUD-INJ-2 AUD-INJ-3 AUD-INJ-4', 'critical', 'A03:2021 – Injection', 'CWE-89'), ('AUD-INJ-5 AUD-INJ-6 AUD-INJ-7', 'critical', 'A03:2021 – Injection', 'CWE-78'), ('AUD-ACC-1', 'high', 'A01:2021 – 访问控制失效', 'CWE-862'),
    ('AUD-SEN-1 AUD-SEN-2 AUD-SEN-3 AUD-SEN-4', 'critical', 'A04:2021 – 不安全的设计', 'CWE-798'), ('AUD-SEN-5', 'high', 'A02:2021 – 加密机制失效', 'CWE-319'),
    ('AUD-XSS-1 AUD-XSS-4', 'critical', 'A03:2021 – Injection (XSS)', 'CWE-79'), ('AUD-XSS-2 AUD-XSS-3 AUD-XSS-5', 'high', 'A03:2021 – Injection (XSS)', 'CWE-79'),
    ('AUD-DES-1 AUD-DES-2 AUD-DES-3 AUD-DES-4', 'critical', 'A08:2021 – 软件和数据完整性故障', 'CWE-502'), ('AUD-DES-5', 'high', 'A08:2021 – 软件和数据完整性故障', 'CWE-502'),
    ('AUD-LOG-1 AUD-LOG-2 AUD-LOG-3 AUD-LOG-4 AUD-LOG-5', 'medium', 'A09:2021 – 安全日志记录和监控故障', 'CWE-532'), ('AUD-AST-1', 'critical', 'A07:2021 – 身份识别和身份验证失败', 'CWE-798'),
    ('AUD-PTH-1 AUD-PTH-2 AUD-PTH-3', 'high', 'A01:2021 – 访问控制失效', 'CWE-22'), ('AUD-CRY-1 AUD-CRY-2', 'medium', 'A02:2021 – 加密机制失效', 'CWE-328'), ('AUD-CRY-3 AUD-CRY-4', 'medium', 'A02:2021 – 加密机制失效', 'CWE-338')
    ) AS t(ids, severity, owasp, cwe)"""
)
def rule_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, OWASP category and CWE of every rule, against values that are stated by hand."""
    return catalogue(spark).select("rule_id", "severity", "owasp", "cwe")


@query()
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and advice of every rule, in our own words."""
    return catalogue(spark).select("rule_id", "severity", "owasp", "cwe", "title", "advice")


# Layers.


def _layer_sql() -> str:
    names = [n for n, _ in LAYERS]
    by_name = " ".join(f"WHEN contains(lower(path), {quoted(n)}) THEN {quoted(n)}" for n in names)
    folder = []
    for generic, words in layers.GENERIC.items():
        layer = layers.matching_layer(generic, names)
        if layer:
            told = " OR ".join(f"contains(string_split(lower(path), '/')[-2], {quoted(w)})" for w in words)
            folder.insert(0, f"WHEN {told} THEN {quoted(layer)}")
    return f"CASE {by_name} {' '.join(folder)} END"


LAYERED_SQL = f"WITH {ARCH_SQL}, layered AS (SELECT path, {_layer_sql()} AS layer FROM afiles)"


@query(f"{LAYERED_SQL} SELECT path, layer FROM layered")
def arch_file_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.file_layers(arch_files(spark, sf_dir), [n for n, _ in LAYERS])


_FORBIDDEN_SQL = "forbidden(layer, target_layer) AS (VALUES " + ", ".join(f"({quoted(n)}, {quoted(t)})" for n, ts in LAYERS for t in ts) + ")"
_TARGET_SQL = """targets AS (
  SELECT e.*, coalesce(
    (SELECT min(f.path) FROM afiles f WHERE regexp_extract(f.path, '([^/]*)\\.py$', 1) = string_split(e.module, '.')[-1]),
    (SELECT min(f.path) FROM afiles f WHERE contains(replace(lower(f.path), '.py', ''), replace(e.module, '.', '/')))) AS target
  FROM aedges e)"""


@query(f"{LAYERED_SQL}, {_TARGET_SQL} SELECT path, seq, module, target FROM targets")
def arch_imported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.imported_files(arch_edges(spark, sf_dir), arch_files(spark, sf_dir))


@query(
    f"{LAYERED_SQL}, {_TARGET_SQL}, {_FORBIDDEN_SQL} SELECT t.path, seq, module, a.layer, target, b.layer AS target_layer FROM targets t"
    " JOIN layered a ON a.path = t.path JOIN layered b ON b.path = t.target JOIN forbidden f ON f.layer = a.layer AND f.target_layer = b.layer WHERE a.layer != b.layer"
)
def arch_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = spark.createDataFrame([(design_json(),)], "json string")
    return layers.violations(arch_edges(spark, sf_dir), arch_files(spark, sf_dir), layers.layer_list(layers.layers_of(design)))


@query(f"{LAYERED_SQL} SELECT count(*) AS modules_analyzed, list_sort(list(DISTINCT layer) FILTER (layer IS NOT NULL)) AS layers_detected, {len(LAYERS)} AS constraints_checked FROM layered")
def arch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.files import with_path_parts

    files = with_path_parts(arch_files(spark, sf_dir).withColumn("content", F.lit("")))
    return arch.arch_summary(files, spark.createDataFrame([(design_json(),)], "json string"))


# Frozen specifications, made of regions (modules, models), nations (functions, fields) and parts (endpoints).


def _spec_modules(spark: SparkSession, sf_dir: str, now: bool) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    key, group = F.col("s_suppkey"), F.col("s_suppkey") % 23
    rows = supplier.select(F.concat(F.lit("mod"), group.cast("string")).alias("name"), key.alias("key"), F.col("s_name").alias("api"), group.alias("g"))
    if now:
        rows = rows.where("key % 7 != 0 AND g % 5 != 1")
    return rows.groupBy("name").agg(F.array_sort(F.collect_list("api")).alias("public_api"))


def _spec_models(spark: SparkSession, sf_dir: str, now: bool) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    rows = customer.select(F.concat(F.lit("model"), F.col("c_nationkey").cast("string")).alias("name"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("g"), F.col("c_name").alias("field"))
    if now:
        rows = rows.where("key % 7 != 0 AND g % 6 != 1")
    return rows.groupBy("name").agg(F.collect_list(F.struct(F.col("field").alias("name"))).alias("fields"))


def _spec_endpoints(spark: SparkSession, sf_dir: str, now: bool) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey % 3 != 0" if now else "p_partkey % 2 = 0")
    method = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 2 == 0, "GET").otherwise("POST")
    return part.select(method.alias("method"), F.concat(F.lit("/"), F.col("p_brand"), F.lit("/"), (F.col("p_partkey") % 50).cast("string")).alias("path"))


SPEC_SQL = """WITH om AS (SELECT 'mod' || (s_suppkey % 23)::VARCHAR AS name, s_suppkey AS key, s_suppkey % 23 AS g, s_name AS api FROM supplier),
nm AS (SELECT * FROM om WHERE key % 7 != 0 AND g % 5 != 1),
oe AS (SELECT 'model' || c_nationkey::VARCHAR AS name, c_custkey AS key, c_nationkey AS g, c_name AS field FROM customer),
ne AS (SELECT * FROM oe WHERE key % 7 != 0 AND g % 6 != 1),
ends AS (SELECT CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || p_brand || '/' || (p_partkey % 50)::VARCHAR AS path, p_partkey FROM part),
op AS (SELECT method, path FROM ends WHERE p_partkey % 2 = 0), np AS (SELECT method, path FROM ends WHERE p_partkey % 3 != 0)"""


@query(f"{SPEC_SQL} SELECT DISTINCT name FROM om WHERE name NOT IN (SELECT name FROM nm)")
def freeze_modules_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.modules_removed(_spec_modules(spark, sf_dir, False), _spec_modules(spark, sf_dir, True))


@query(f"{SPEC_SQL} SELECT name, list_sort(list(DISTINCT api)) AS removed FROM om WHERE name IN (SELECT name FROM nm) AND (name, api) NOT IN (SELECT (name, api) FROM nm) GROUP BY name")
def freeze_apis_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.apis_removed(_spec_modules(spark, sf_dir, False), _spec_modules(spark, sf_dir, True))


@query(f"{SPEC_SQL} SELECT DISTINCT name FROM oe WHERE name NOT IN (SELECT name FROM ne)")
def freeze_models_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.models_removed(_spec_models(spark, sf_dir, False), _spec_models(spark, sf_dir, True))


@query(f"{SPEC_SQL} SELECT DISTINCT name AS model, field FROM oe WHERE name IN (SELECT name FROM ne) AND (name, field) NOT IN (SELECT (name, field) FROM ne)")
def freeze_fields_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.fields_removed(_spec_models(spark, sf_dir, False), _spec_models(spark, sf_dir, True))


_REMOVED_SQL = f"""{SPEC_SQL}, found AS (
  SELECT DISTINCT 'module_removed' AS type, name AS subject, '' AS detail FROM om WHERE name NOT IN (SELECT name FROM nm)
  UNION ALL SELECT 'api_removed', name, string_agg(api, ',' ORDER BY api) FROM (SELECT DISTINCT name, api FROM om) WHERE name IN (SELECT name FROM nm) AND (name, api) NOT IN (SELECT (name, api) FROM nm) GROUP BY name
  UNION ALL (SELECT DISTINCT 'model_removed', name, '' FROM oe WHERE name NOT IN (SELECT name FROM ne))
  UNION ALL (SELECT DISTINCT 'field_removed', name, field FROM oe WHERE name IN (SELECT name FROM ne) AND (name, field) NOT IN (SELECT (name, field) FROM ne)))"""


def _compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.compliance(*[f(spark, sf_dir, now) for f in (_spec_modules, _spec_models) for now in (False, True)])


@query(f"{_REMOVED_SQL} SELECT type, CASE WHEN type IN ('module_removed', 'api_removed') THEN 'P0' ELSE 'P1' END AS severity, subject, detail FROM found")
def freeze_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compliance(spark, sf_dir)


@query(f"{_REMOVED_SQL} SELECT count(*) AS violations, count(*) = 0 AS compliant FROM found")
def freeze_compliant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.compliant(_compliance(spark, sf_dir))


@query(f"{SPEC_SQL}, o AS (SELECT name, list_sort(list(api)) AS public_api FROM om GROUP BY name), n AS (SELECT name, list_sort(list(api)) AS public_api FROM nm GROUP BY name) SELECT coalesce(n.name, o.name) AS name, coalesce(n.public_api, o.public_api) AS public_api FROM o FULL JOIN n ON o.name = n.name")
def freeze_ratchet_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.ratchet(_spec_modules(spark, sf_dir, False), _spec_modules(spark, sf_dir, True))


@query(f"{SPEC_SQL} SELECT method, path, 'old' AS origin FROM op UNION ALL SELECT method, path, 'new' FROM np WHERE NOT EXISTS (SELECT 1 FROM op WHERE op.method IS NOT DISTINCT FROM np.method AND op.path IS NOT DISTINCT FROM np.path)")
def freeze_endpoints_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.merge_endpoints(_spec_endpoints(spark, sf_dir, False), _spec_endpoints(spark, sf_dir, True))


@query(f"{SPEC_SQL} SELECT (SELECT count(DISTINCT name) FROM om) AS modules, (SELECT count(DISTINCT name) FROM oe) AS models")
def freeze_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.freeze_counts(_spec_modules(spark, sf_dir, False), _spec_models(spark, sf_dir, False))


# The log and documents.


@query("SELECT event_type AS step, max(event_id) AS seq, substring(max_by(props, event_id), 1, 500) AS input_summary FROM events GROUP BY event_type")
def trace_last_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), F.col("event_id").alias("seq"), F.substring("props", 1, 500).alias("input_summary"))
    return last_per_step(log, "seq")


@query("SELECT doc_id, substring(text, 1, 500) AS input_summary, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS shown FROM documents")
def trace_summary_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 500).alias("input_summary"), shorten(F.col("text")).alias("shown"))


@query("SELECT doc_id, substring(sha256(text), 1, 12) AS hash FROM documents")
def doc_hash12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hash12(F.col("text")).alias("hash"))


_RESEARCH = """CASE p_partkey % 3
 WHEN 0 THEN '{"recommendation":{"reasoning":"because ' || p_name || '"},"market_analysis":{"target_users":["' || p_brand || '","all"]},"opportunity_windows":[{"suggested_approach":"use ' || p_type || '"},{"suggested_approach":""}],"user_pain_points":[{"pain_point":"slow"},{}]}'
 WHEN 1 THEN '{"recommendation":{},"user_pain_points":[{"pain_point":"' || p_brand || '"}]}'
 ELSE '{"opportunity_windows":[{"opportunity":"x"}]}' END"""


@query(f"""WITH r AS (SELECT p_partkey, ({_RESEARCH})::JSON AS j FROM part),
f AS (SELECT p_partkey, list_filter(coalesce(json_extract_string(j, '$.opportunity_windows[*].suggested_approach'), []), lambda x: x != '') AS said, j FROM r)
SELECT p_partkey, coalesce(j->'recommendation'->>'reasoning', '') AS product_goal, coalesce(json_extract_string(j, '$.market_analysis.target_users[*]'), []) AS target_users,
CASE WHEN len(said) > 0 THEN said ELSE [{quoted(documents.NO_FEATURES)}] END AS core_features,
list_transform(coalesce(json_extract(j, '$.user_pain_points[*]'), []), lambda p: coalesce(p->>'pain_point', '')) AS pain_points_addressed,
[{listed(documents.METRICS)}] AS success_metrics FROM f""")
def define_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.define(table(spark, sf_dir, "part").select("p_partkey", F.expr(_RESEARCH).alias("json")))


_DESIGN = """'{"tech_stack":{"language":"' || p_brand || '","framework":"' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END || '","other":["a","b' || p_size::STRING || '"]},"coding_standards":{"max_line_length":' || p_size::STRING || ',"require_docstrings":false},"architecture":{"layers":[{"name":"api","forbidden_dependencies":["db","db"],"allowed_dependencies":["svc"]},{"name":"' || p_brand || '","forbidden_dependencies":["api"]}]}}'"""


@query(f"""WITH d AS (SELECT ({_DESIGN})::JSON AS j FROM part)
SELECT array_to_string(list_concat(list_transform(list_filter(['language', 'framework', 'database', 'cache', 'message_queue'], lambda k: coalesce(j->'tech_stack'->>k, '') != ''), lambda k: k || '=' || (j->'tech_stack'->>k)), ['other_tools=' || array_to_string(json_extract_string(j, '$.tech_stack.other[*]'), ', ')]), ';') AS stack FROM d""")
def context_tech_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    designs = freeze.parsed(table(spark, sf_dir, "part").select(F.expr(_DESIGN).alias("json")))
    stack = documents.tech_stack(F.col("design.tech_stack"))
    return designs.select(F.array_join(F.transform(F.map_entries(stack), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("stack"))


@query(f"""WITH d AS (SELECT ({_DESIGN})::JSON AS j FROM part)
SELECT ['layer api must not depend on layer db', 'layer ' || (j->'architecture'->'layers'->1->>'name') || ' must not depend on layer api', 'layer api may depend on layer svc'] AS constraints FROM d""")
def context_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    designs = freeze.parsed(table(spark, sf_dir, "part").select(F.expr(_DESIGN).alias("json")))
    return designs.select(documents.constraints(F.col("design.architecture.layers")).alias("constraints"))


@query(f"""WITH d AS (SELECT ({_DESIGN})::JSON AS j FROM part)
SELECT j->'coding_standards'->>'max_line_length' AS max_line_length, 'snake_case' AS naming_style, 'True' AS require_type_annotations, 'False' AS require_docstrings, 'try-except' AS error_handling_pattern FROM d""")
def context_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    designs = freeze.parsed(table(spark, sf_dir, "part").select(F.expr(_DESIGN).alias("json")))
    standards = documents.coding_standards(F.col("design.coding_standards"))
    return designs.select(*[standards[k].alias(k) for k in documents.STANDARDS])


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN '[' || p_partkey::VARCHAR || ']' WHEN 3 THEN NULL ELSE '{"k": ' || p_partkey::VARCHAR || '}' END AS json,
CASE p_partkey % 4 WHEN 3 THEN 'nothing ' || p_partkey::VARCHAR END AS error FROM part""")
def extract_json_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in answers of several forms."""
    key = F.col("p_partkey").cast("string")
    forms = F.array(
        F.concat(F.lit('{"k": '), key, F.lit("}")),
        F.concat(F.lit('text\n```json\n{"k": '), key, F.lit("}\n```\nmore")),
        F.concat(F.lit("a\n```\nno\n```\nb\n```\n[") , key, F.lit("]\n```")),
        F.concat(F.lit("nothing "), key),
    )
    answers = table(spark, sf_dir, "part").select("p_partkey", F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int")).alias("content"))
    return documents.extract_json(answers).select("p_partkey", "json", "error")


_CANONICAL = """'{"architecture": {"layers": [{"allowed_dependencies": ["svc"], "forbidden_dependencies": ["db", "db"], "name": "api"}, {"forbidden_dependencies": ["api"], "name": "' || p_brand || '"}]}, "coding_standards": {"max_line_length": ' || p_size::VARCHAR || ', "require_docstrings": false}, "tech_stack": {"framework": "' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END || '", "language": "' || p_brand || '", "other": ["a", "b' || p_size::VARCHAR || '"]}}'"""


@query(f"SELECT p_partkey, substring(sha256({_CANONICAL}), 1, 12) AS hash FROM part")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.canonical_hash(table(spark, sf_dir, "part").select("p_partkey", F.expr(_DESIGN).alias("json"))).select("p_partkey", "hash")


# Readers and writers: rows go out by a sink, come back by a source, and must be those of the table.


def _folder(spark: SparkSession) -> str:
    return Workspace(spark, "round-trip").root.removeprefix("file:")


_NATION_FILES = """files AS (
  SELECT CASE WHEN n_nationkey % 7 = 0 THEN 'build/' WHEN n_nationkey % 5 = 0 THEN '_own/' ELSE 'src/' END || 'n' || n_nationkey::VARCHAR || CASE WHEN n_nationkey % 4 = 3 THEN '.txt' ELSE '.py' END AS path, n_nationkey, n_name FROM nation)"""


@query(f"""WITH {_NATION_FILES} SELECT path, n_nationkey % 3 = 0 AS broken, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 2 END AS n_lines
FROM files WHERE path NOT LIKE 'build/%' AND path LIKE '%.py'""")
def files_from_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated files, some of them broken text, some in excluded or hidden folders, scanned for the static check."""
    key = F.col("n_nationkey")
    folder = F.when(key % 7 == 0, "build/").when(key % 5 == 0, "_own/").otherwise("src/")
    path = F.concat(folder, F.lit("n"), key.cast("string"), F.when(key % 4 == 3, ".txt").otherwise(".py"))
    content = F.when(key % 3 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.concat("n_name", F.lit("\nx")).cast("binary"))
    root = _folder(spark)
    write_generated(table(spark, sf_dir, "nation").select(path.alias("path"), content.alias("content")), root).where("NOT written").count()
    found = scan(files_from_dir(spark, root, "static"), "static")
    many = lines(found).groupBy("path").agg(F.count("*").alias("n_lines"))
    rows = found.join(many, "path", "left").select(F.substring("path", len(root) + 2, 1000).alias("path"), F.col("content").isNull().alias("broken"), F.coalesce("n_lines", F.lit(0)).cast("int").alias("n_lines"))
    return rows


@query("""SELECT event_id, event_type AS step, user_id::INT AS max_tokens, substring(sha256(event_type), 1, 8) AS prompt_template_version, substring(props, 1, 500) AS input_summary,
CASE WHEN event_id % 2 = 0 THEN 'n/a' ELSE substring(sha256(props), 1, 12) END AS output_hash FROM events""")
def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended to a log with a key of their own, and read back."""
    events = table(spark, sf_dir, "events")
    steps = events.select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("step"), F.lit("m").alias("model"), F.col("value").alias("temperature"), F.col("user_id").alias("max_tokens"),
        F.col("event_type").alias("template"), F.col("props").alias("summary"), F.when(F.col("event_id") % 2 == 1, F.col("props")).alias("output"), "event_id",
    )
    root = _folder(spark)
    for rest in (0, 1):
        append_json_lines(make_records(steps.where(F.col("event_id") % 2 == rest), "event_id"), root)
    log = read_trace(spark, root)
    return log.select(F.col("extra")["event_id"].cast("long").alias("event_id"), "step", F.col("parameters.max_tokens").alias("max_tokens"), "prompt_template_version", "input_summary", "output_hash")


_SPEC = """named AS (SELECT r_name AS name, list_sort(list(n_name)) AS public_api FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)"""


def _spec_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (modules): a module for each region, with its nations as functions."""
    both = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = both.groupBy(F.col("r_name").alias("name")).agg(F.array_sort(F.collect_list("n_name")).alias("public_api"))
    return named.agg(F.sort_array(F.collect_list(F.struct("name", "public_api"))).alias("modules"))  # region has a fixed number of rows


@query(f"WITH {_SPEC} SELECT name, public_api FROM named")
def freeze_from_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A design written as a document, read back, and its modules extracted."""
    root = _folder(spark)
    write_document(_spec_document(spark, sf_dir), f"{root}/design.json")
    return freeze.modules(freeze.parsed(read_document(spark, "design.json", f"{root}/none", root))).select("name", "public_api")


@query("SELECT * FROM (VALUES (0, 'research.json', 5), (2, 'design.json', 25)) AS t(ord, file_name, n)")
def context_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context files in the order of reading; one that is no JSON is left out."""
    root = _folder(spark)
    listed_rows = lambda name: table(spark, sf_dir, name).agg(F.collect_list(F.struct("*")).alias("rows"))
    write_document(listed_rows("region"), f"{root}/research.json")
    write_document(listed_rows("nation"), f"{root}/design.json")
    write_generated(spark.createDataFrame([("define.json", "{bad")], "path string, content string"), root).collect()
    return read_context_files(spark, root).select("ord", "file_name", F.size(F.from_json("json", "struct<rows:array<map<string,string>>>")["rows"]).alias("n"))


@query("""SELECT '{"n_nationkey":' || n_nationkey::VARCHAR || ',"n_name":"' || n_name || '","none":null}' AS json FROM nation""")
def json_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


_SAID = ("error", "fatal", "warning", "refactor", "convention", "other")


@query(f"""SELECT n_nationkey, CASE ([{listed(_SAID)}])[n_nationkey % 6 + 1] WHEN 'error' THEN 'P0' WHEN 'fatal' THEN 'P0' WHEN 'warning' THEN 'P1' ELSE 'P2' END AS pylint,
CASE n_nationkey % 4 WHEN 2 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'P2' END AS eslint FROM nation""")
def linter_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", level(pick(_SAID, key % 6), PYLINT_LEVELS).alias("pylint"), level((key % 4).cast("string"), ESLINT_LEVELS).alias("eslint"))


@query(f"""WITH {DOC_LINES_SQL}, wanted AS (SELECT DISTINCT path, 'word' || (length(path) % 3)::VARCHAR AS module FROM dlines),
coded AS (SELECT path, line_no, CASE line_no % 4 WHEN 1 THEN 'x word0 word1' WHEN 2 THEN 'import word1' WHEN 3 THEN 'from word2 import word0' ELSE line END AS line FROM dlines)
SELECT w.path, w.module, coalesce((SELECT min(line_no) FROM coded c WHERE c.path = w.path AND contains(c.line, w.module) AND (contains(c.line, 'import') OR contains(c.line, 'from'))), 0)::INT AS line_no FROM wanted w""")
def arch_import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lines(_documents(spark, sf_dir)).select("path", "line_no", "line")
    place = F.col("line_no") % 4
    coded = source.withColumn("line", F.when(place == 1, "x word0 word1").when(place == 2, "import word1").when(place == 3, "from word2 import word0").otherwise(F.col("line")))
    wanted = source.select("path").distinct().withColumn("module", F.concat(F.lit("word"), (F.length("path") % 3).cast("string")))
    return layers.import_lines(wanted, coded).select("path", "module", "line_no")


@query(f"WITH {PLANTED_SQL} SELECT concat_ws(', ', CASE WHEN bool_or(suffix = '.py') THEN 'builtin-python' END, CASE WHEN bool_or(suffix IN ('.js', '.ts')) THEN 'builtin-script' END) AS tools FROM planted")
def gate_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.tools_used(planted_files(spark, sf_dir))


@query(f"""WITH {PLANTED_SQL}, p AS (SELECT DISTINCT path FROM planted) SELECT path FROM (SELECT path FROM p ORDER BY path LIMIT 20)
UNION ALL SELECT '+' || (count(*) - 20)::VARCHAR || ' more' FROM p HAVING count(*) > 20""")
def shown_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.shown_files(planted_files(spark, sf_dir))


@query(f"""WITH d AS (SELECT p_partkey, ({_DESIGN})::JSON AS j FROM part)
SELECT '## Context' || chr(10) || chr(10) || '### Technology' || chr(10) || '- language: ' || (j->'tech_stack'->>'language') || CASE WHEN (j->'tech_stack'->>'framework') != '' THEN chr(10) || '- framework: ' || (j->'tech_stack'->>'framework') ELSE '' END
|| chr(10) || '- other_tools: a, ' || (j->'tech_stack'->'other'->>1) || chr(10) || chr(10) || '### Standards' || chr(10) || '- max_line_length: ' || (j->'coding_standards'->>'max_line_length') || chr(10) || '- naming_style: snake_case' || chr(10)
|| '- require_type_annotations: True' || chr(10) || '- require_docstrings: False' || chr(10) || '- error_handling_pattern: try-except' || chr(10) || chr(10) || '### Constraints' || chr(10) || '- layer api must not depend on layer db' || chr(10)
|| '- layer ' || (j->'architecture'->'layers'->1->>'name') || ' must not depend on layer api' || chr(10) || '- layer api may depend on layer svc' || chr(10) || chr(10) || '### Frozen specification' || chr(10) || '```json' || chr(10) || '{{"a":1}}' || chr(10) || '```' || chr(10) AS markdown FROM d""")
def context_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of designs with a frozen specification attached, as markdown."""
    designs = freeze.parsed(table(spark, sf_dir, "part").select(F.expr(_DESIGN).alias("json")))
    return documents.as_markdown(documents.context(designs, spark.createDataFrame([('{"a":1}',)], "json string")))
