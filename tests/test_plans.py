"""Scans, syntax trees, the gate, the audit and layers on small trees of files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sieveline.operators.findings import numbered
from sieveline.operators.layers import file_layers, imported_files, import_lines, layer_list, layers_of, violations
from sieveline.operators.syntax import dangerous_calls, imports, nodes_of, parsed, secret_assignments, syntax_nodes
from sieveline.plans import arch, audit, gate
from sieveline.sources.files import files_from_dir, files_scanned, lines, scan, with_path_parts
from sieveline.sources.linters import ESLINT_LEVELS, PYLINT_LEVELS, level, lint, parse


def tree(folder, files):
    for name, content in files.items():
        place = os.path.join(folder, name)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(place, "wb") as out:
            out.write(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def files_of(spark, files):
    return with_path_parts(spark.createDataFrame(list(files.items()), "path string, content string"))


def test_folders_suffixes_and_broken_text(spark, tmp_path):
    root = tree(tmp_path, {"a.py": "x\n", "build/b.py": "x", "egg-info/c.py": "x", "foo.egg-info/d.py": "x", "e.json": "{}", "bad.py": b"\xff\xfe", "n.PY": "x", "w/.mypy_cache/f.py": "x", "w/__init__.py": "y"})
    found = lambda check: sorted(r["path"].removeprefix(root + "/") for r in scan(files_from_dir(spark, root, check), check).collect())
    assert found("static") == ["a.py", "bad.py", "foo.egg-info/d.py", "w/__init__.py"]
    assert found("security") == ["a.py", "bad.py", "foo.egg-info/d.py", "w/.mypy_cache/f.py", "w/__init__.py"]
    assert found("audit") == ["a.py", "bad.py", "e.json", "foo.egg-info/d.py", "w/__init__.py"]
    files = files_from_dir(spark, root)
    assert files_scanned(files, "static").first()[0] == 4
    assert {r["path"].removeprefix(root + "/"): r["content"] for r in files.collect()}["bad.py"] is None
    assert lines(files.where(F.col("path").endswith("bad.py"))).count() == 0


def test_lines_of_all_newlines(spark):
    rows = lines(files_of(spark, {"a.py": "a\nb\n", "b.py": "a\r\nb\rc", "c.py": "", "d.py": " x"})).collect()
    got = {}
    for r in rows:
        got.setdefault(r["path"], []).append((r["line_no"], r["line"]))
    assert got == {"a.py": [(1, "a"), (2, "b"), (3, "")], "b.py": [(1, "a"), (2, "b"), (3, "c")], "c.py": [(1, "")], "d.py": [(1, " x")]}


@pytest.mark.parametrize(
    "source, calls",
    [("m.eval()", []), ("g().eval()", ["SEC-AST-1"]), ("x[0].exec()", ["SEC-AST-1"]), ("a.b().pickle.loads(z)", ["SEC-AST-2"]), ("f()()", []), ("eval(a); exec(b)", ["SEC-AST-1", "SEC-AST-1"]), ("import pickle as p; p.loads(z)", []), ("def broken(:", []), ("﻿eval(a)", []), ("yaml.load(s, Loader=L)", ["SEC-AST-4"]), ("subprocess.run(c)", []), ("os.popen(c)", ["SEC-AST-3"])],
)
def test_calls(spark, source, calls):
    assert [r["rule_id"] for r in dangerous_calls(syntax_nodes(files_of(spark, {"m.py": source}))).collect()] == calls


def test_assignments_and_imports(spark):
    source = 'db_password = "abcde"\nmy_token = "abcd"\nself.token = "abcdef"\ntoken: str = "abcdef"\nA = SECRET = "123456"\nfrom . import x\nfrom .a import b\nimport a.b, c\n'
    nodes = syntax_nodes(files_of(spark, {"m.py": source, "n.js": source}))
    assert [(r["line_no"], r["name"], r["snippet"]) for r in secret_assignments(nodes).collect()] == [(1, "db_password", "db_password = '***'"), (5, "SECRET", "SECRET = '***'")]
    assert [r["module"] for r in imports(nodes).orderBy("seq").collect()] == ["a", "a.b", "c"]
    nodes_of("x" + ".a()" * 20_000)  # deep chains must not stop a run


def test_security_issues_once_each_and_in_order(spark):
    files = files_of(spark, {"b/z.py": "eval(a); eval(b)\nx = 1\npassword = 'abcdefgh1'\n", "a/y.py": "# eval(\nexec(a)\n", "a/x.js": "box.innerHTML = v"})
    rows = gate.security_issues(files).orderBy("id").collect()
    assert [(r["id"], r["path"], r["line_no"], r["rule_id"]) for r in rows] == [("SEC-001", "a/x.js", 1, "SEC-RX-6"), ("SEC-002", "a/y.py", 2, "SEC-AST-1"), ("SEC-003", "b/z.py", 1, "SEC-AST-1"), ("SEC-004", "b/z.py", 3, "SEC-RX-4")]
    assert rows[3]["owasp"].startswith("A07:2021") and rows[3]["snippet"] == "password = 'abcdefgh1'"


def test_static_issues_put_python_first(spark):
    rows = gate.static_issues(lines(files_of(spark, {"a.js": "var x", "z.py": "print(1)\nexcept :", "b.py": "    # TODO x"}))).orderBy("id").collect()
    assert [(r["id"], r["path"], r["rule_id"]) for r in rows] == [("SA-001", "z.py", "SA-PY-1"), ("SA-002", "z.py", "SA-PY-2"), ("SA-003", "a.js", "SA-JS-2")]


def test_gate_report(spark):
    files = files_of(spark, {"api/a.py": "from db import m\neval(x)\nprint(1)\n", "db/m.py": "x = 1\n"})
    design = spark.createDataFrame([(json.dumps({"architecture": {"layers": [{"name": "api", "forbidden_dependencies": ["db"]}, {"name": "db"}]}}),)], "json string")
    checks = {"static_analysis": gate.static_issues(lines(scan(files, "static"))), "security_scan": gate.security_issues(files), "arch_compliance": arch.arch_issues(files, design)}
    r = gate.report(checks, "x").first()
    assert r["checks"] == {"static_analysis": True, "security_scan": False, "arch_compliance": True}
    assert (r["total_issues"], r["p0_blockers"], r["blocked"], r["passed"], r["force_bypass"]) == (3, 1, True, False, False)
    forced = gate.report(checks, "x", force=True).first()
    assert (forced["blocked"], forced["passed"], forced["force_bypass"]) == (False, True, True)
    table = {x["check"]: x["total"] for x in gate.crosstab(gate.all_issues(checks)).collect()}
    assert table == {"static_analysis": 1, "security_scan": 1, "arch_compliance": 1, None: 3}
    assert gate.missing_directory(spark, "static_analysis", "/none").first()["severity"] == "P0"
    assert not gate.check_passed(checks["security_scan"]).first()[0] and gate.check_passed(checks["static_analysis"].limit(0)).first()[0]
    assert gate.tools_used(files).first()[0] == "builtin-python"


def test_audit_report(spark):
    files = files_of(spark, {"a.py": 'password = "abcdef"\nhashlib.md5(x)\n@app.route("/")\ndef f(): yaml.load(f)\n', "my_example.py": 'secret = "abcdef"\n', "b.html": "x.innerHTML = y\n"})
    found = audit.findings(files)
    rows = {(r["path"], r["line_no"], r["rule_id"]) for r in found.collect()}
    assert rows == {("a.py", 1, "AUD-SEN-1"), ("a.py", 1, "AUD-AST-1"), ("a.py", 2, "AUD-CRY-1"), ("a.py", 3, "AUD-ACC-1"), ("a.py", 4, "AUD-DES-4"), ("my_example.py", 1, "AUD-AST-1"), ("b.html", 1, "AUD-XSS-1")}
    assert [r["rule_id"] for r in found.where("path = 'a.py'").orderBy("id").collect()] == ["AUD-ACC-1", "AUD-SEN-1", "AUD-DES-4", "AUD-AST-1", "AUD-CRY-1"]
    report = audit.report(found, files_scanned(files, "audit")).first()
    assert report["timestamp"].endswith("+00:00") and report["tool"] and report["code_directory"] == ""
    assert (report["files_scanned"], report["critical"], report["high"], report["medium"], report["low"], report["risk_score"]) == (3, 5, 1, 1, 0, 57.0)
    plan = {r["priority"]: (r["action"], r["findings"]) for r in audit.remediation(found).collect()}
    assert plan[2][0] == "fix 1 high findings soon" and len(plan[1][1]) == 5
    assert audit.remediation_counts(found).count() == 3
    messages = [r["message"] for r in audit.annotations(found).orderBy("id", "part").collect()]
    assert len(messages) == 14 and messages[0].startswith("::error file=a.py,line=3,title=")
    assert audit.ci_summary(found).first().asDict() == {"critical": 5, "high": 1, "total": 7, "exit_code": 1}
    assert {r["severity"]: r["share"] for r in audit.severity_share(found).collect()} == {"critical": "71%", "high": "14%", "medium": "14%"}
    nothing = found.limit(0)
    assert audit.risk_score(nothing).first()[0] == 0 and audit.severity_share(nothing).collect() == [] and audit.ci_summary(nothing).first()["exit_code"] == 0


def test_numbers_do_not_depend_on_partitions(spark):
    rows = [(f"d{i % 3}/f{i % 7}.py", i % 2, 0, i, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, phase int, ordinal int, line_no int, seq int")
    a = {tuple(r) for r in numbered(df, "%05d").collect()}
    b = {tuple(r) for r in numbered(df.repartition(7), "%05d").collect()}
    ordered = sorted(a, key=lambda r: r[-1])
    assert a == b and [r[-1] for r in ordered] == [f"{i:05d}" for i in range(1, 201)]
    assert ordered == sorted(a, key=lambda r: (r[0].rsplit("/", 1)[0], *r[:5]))


def test_layers(spark):
    doc = {"layers": [{"name": "Ctrl"}, {"name": ""}, {"name": "service", "forbidden_dependencies": ["x"]}, {"name": "service", "forbidden_dependencies": ["Ctrl"]}, {"name": "data_repository"}]}
    layers = layer_list(layers_of(spark.createDataFrame([(json.dumps(doc),)], "json string")))
    assert layers == [("Ctrl", []), ("service", ["Ctrl"]), ("data_repository", [])]
    names = [n for n, _ in layers]
    paths = ["x/CTRL/a.py", "x/service/ctrl.py", "x/dao/a.py", "x/usecase_data/a.py", "a.py", "x/views/a.py"]
    got = {r["path"]: r["layer"] for r in file_layers(spark.createDataFrame([(p,) for p in paths], "path string"), names).collect()}
    assert got == {"x/CTRL/a.py": "Ctrl", "x/service/ctrl.py": "Ctrl", "x/dao/a.py": "data_repository", "x/usecase_data/a.py": "data_repository", "a.py": None, "x/views/a.py": None}


def test_imports_find_their_files(spark):
    files = spark.createDataFrame([("b/m.py",), ("a/m.py",), ("pkg/sub/n.py",), ("Pkg/Up/q.py",)], "path string")
    edges = spark.createDataFrame([("x", 0, "m"), ("x", 1, "z.m"), ("x", 2, "sub.nn"), ("x", 3, "pkg.sub"), ("x", 4, "pkg.up"), ("x", 5, "Pkg.Up"), ("x", 6, "u"), ("x", 7, "os")], "path string, seq int, module string")
    got = {r["seq"]: r["target"] for r in imported_files(edges, files).collect()}
    assert got == {0: "a/m.py", 1: "a/m.py", 2: None, 3: "pkg/sub/n.py", 4: "Pkg/Up/q.py", 5: None, 6: "Pkg/Up/q.py", 7: None}


def test_repeated_imports_are_repeated_issues(spark):
    files = spark.createDataFrame([("api/a.py",), ("db/m.py",)], "path string")
    edges = spark.createDataFrame([("api/a.py", 0, "db.m"), ("api/a.py", 1, "db.m"), ("db/m.py", 0, "a")], "path string, seq int, module string")
    found = violations(edges, files, [("api", ["db"]), ("db", [])])
    source = spark.createDataFrame([("api/a.py", 1, "db.m = 1"), ("api/a.py", 2, "import db.m")], "path string, line_no int, line string")
    assert sorted((r["seq"], r["line_no"]) for r in import_lines(found, source).collect()) == [(0, 2), (1, 2)]
    assert arch.issues_of(import_lines(found, source)).count() == 2


def test_linter_output():
    assert parse("pylint", '[{"type": "fatal", "line": 3, "message": "m", "symbol": "s"}, {"type": "x"}]') == [(3, "P0", "m", "pylint: s"), (0, "P2", "", "pylint: ")]
    assert parse("eslint", '[{"messages": [{"severity": 1, "line": 2, "message": "m", "ruleId": "r"}, {}]}]') == [(2, "P1", "m", "eslint: r"), (0, "P0", "", "eslint: ")]
    assert parse("pylint", "  ") == []


def test_linter_levels_and_absence(spark):
    df = spark.createDataFrame([("error", "2"), ("convention", "0"), ("other", "9")], "a string, b string")
    rows = df.select(level(F.col("a"), PYLINT_LEVELS).alias("a"), level(F.col("b"), ESLINT_LEVELS).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("P0", "P0"), ("P2", "P2"), ("P2", "P2")]
    assert lint(files_of(spark, {"a.py": "x"}), "pylint").count() >= 0


def test_one_parse_serves_gate_audit_and_layers(spark, tmp_path):
    files = files_of(spark, {"api/a.py": "from db import m\neval(x)\ndb_password = 'abcde'\n", "db/m.py": "x = 1\n", "build/b.py": "exec(x)"})
    design = spark.createDataFrame([(json.dumps({"layers": [{"name": "api", "forbidden_dependencies": ["db"]}, {"name": "db"}]}),)], "json string")
    nodes = parsed(files)
    by_id = lambda df: sorted(map(repr, df.collect()))
    assert by_id(gate.security_issues(files, nodes)) == by_id(gate.security_issues(files))
    assert by_id(audit.findings(files, nodes)) == by_id(audit.findings(files))
    assert by_id(arch.arch_issues(files, design, nodes)) == by_id(arch.arch_issues(files, design))
    for rows in (gate.security_rows(files, nodes), audit.rows(files, nodes), arch.arch_issues(files, design, nodes)):
        assert "Python" not in rows._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()


def test_titles_tell_rules_apart(spark):
    files = files_of(spark, {"a.py": "cur.execute('SELECT %s' % x)\nos.system(a + b)\neval(x)\ndb_password = 'abcdef'\nhashlib.md5(x)\n"})
    found = {r["rule_id"]: r for r in audit.findings(files).collect()}
    assert "SQL" in found["AUD-INJ-1"]["title"] and "command" in found["AUD-INJ-5"]["title"] and "MD5" in found["AUD-CRY-1"]["title"]
    assert "db_password" in found["AUD-AST-1"]["title"] and "db_password" in found["AUD-AST-1"]["recommendation"]
    assert "password" in found["AUD-SEN-1"]["title"]
    issues = {r["rule_id"]: r for r in gate.security_issues(files).collect()}
    assert issues["SEC-AST-1"]["snippet"] == "line 3" and "eval" in issues["SEC-AST-1"]["title"]
    assert issues["SEC-AST-1"]["owasp"] == "A03:2021 – Injection"


def test_excluded_folders_are_not_entered(spark, tmp_path, monkeypatch):
    from sieveline.sources import files as reader

    names = ["a.py", "x/b.py", "x/y/c.py", "x/y/z/d.js", "node_modules/e.py", "x/.git/f.py", "x/_g/h.py", ".i/j.py", "x/k.txt", "x/build/l.py"]
    root = tree(tmp_path, {n: "x" for n in names})
    for most in (1, 3, 256):
        monkeypatch.setattr(reader, "FOLDERS", most)
        got = {r["path"].removeprefix(root + "/") for r in files_from_dir(spark, root, "static").collect()}
        assert got == {"a.py", "x/b.py", "x/y/c.py", "x/y/z/d.js", "x/_g/h.py", ".i/j.py"}
        assert {r["path"].removeprefix(root + "/") for r in files_from_dir(spark, root).collect()} == set(names)
    os.makedirs(tmp_path / "none")
    assert files_from_dir(spark, str(tmp_path / "none"), "static").count() == 0


def test_forbidden_imports_of_many_layers(spark):
    names = [f"layer{i:02d}" for i in range(40)]
    files = spark.createDataFrame([(f"{n}/m{n}.py",) for n in names], "path string")
    edges = spark.createDataFrame([(f"{a}/m{a}.py", 0, f"m{b}") for a in names for b in names if a != b], "path string, seq int, module string")
    found = violations(edges, files, [(n, names[i + 1 :]) for i, n in enumerate(names)])
    assert found.count() == 40 * 39 // 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = violations(edges, files, [(n, names[i + 1 :]) for i, n in enumerate(names)])._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(code.apply(i)._3().maxMethodCodeSize()) for i in range(code.size())]
    assert max(sizes) < 64 * 1024 and violations(edges, files, [(n, []) for n in names]).count() == 0


def test_imports_by_any_substring(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 4)))
    paths = sorted({"/".join(word() for _ in range(rng.randint(1, 4))) + ".py" for _ in range(60)})
    modules = sorted({".".join(word() for _ in range(rng.randint(1, 3))) for _ in range(150)})
    edges = spark.createDataFrame([("x", i, m) for i, m in enumerate(modules)], "path string, seq int, module string")
    got = {r["module"]: r["target"] for r in imported_files(edges, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    for m in modules:
        stems = [p for p in paths if p.split("/")[-1].removesuffix(".py") == m.split(".")[-1]]
        contain = [p for p in paths if m.replace(".", "/") in p.lower().replace(".py", "")]
        assert got[m] == (min(stems) if stems else min(contain) if contain else None), m
