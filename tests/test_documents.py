"""Designs, frozen specifications, context, the log, sinks and streams."""

import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sieveline.operators import documents, freeze
from sieveline.operators.rules import rules
from sieveline.sources import trace, workspace
from sieveline.streaming import live


def design(spark, *docs):
    return freeze.parsed(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string"))


OLD = {"modules": [{"name": "billing", "public_api": ["charge", "refund"]}, {"name": "ledger", "public_api": ["get"]}], "data_model": {"entities": [{"name": "Invoice", "fields": [{"name": "id"}, {"name": "amount"}]}, {"name": "Entry"}]}, "api_design": {"endpoints": [{"method": "GET", "path": "/a"}, {"path": "/n"}]}}
NEW = {"modules": [{"name": "billing", "public_api": ["charge"]}, {"name": "pay"}], "data_model": {"entities": [{"name": "Invoice", "fields": [{"name": "id"}]}]}, "api_design": {"style": "RPC", "endpoints": [{"method": "GET", "path": "/a", "description": "again"}, {"path": "/n"}, {"method": "PUT", "path": "/b"}, {"method": "PUT", "path": "/b"}]}}


def test_compliance(spark):
    o, n = design(spark, OLD), design(spark, NEW)
    found = freeze.compliance(freeze.modules(o), freeze.modules(n), freeze.models(o), freeze.models(n))
    assert sorted(tuple(r) for r in found.collect()) == [("api_removed", "P0", "billing", "refund"), ("field_removed", "P1", "Invoice", "amount"), ("model_removed", "P1", "Entry", ""), ("module_removed", "P0", "ledger", "")]
    assert freeze.compliant(found).first().asDict() == {"violations": 4, "compliant": False}
    same = freeze.compliance(freeze.modules(o), freeze.modules(o), freeze.models(o), freeze.models(o))
    assert freeze.compliant(same).first()["compliant"]


def test_ratchet(spark):
    o, n = design(spark, OLD), design(spark, NEW)
    merged = {r["name"]: r["public_api"] for r in freeze.ratchet(freeze.modules(o), freeze.modules(n)).collect()}
    assert merged == {"billing": ["charge"], "ledger": ["get"], "pay": []}
    ends = freeze.merge_endpoints(freeze.endpoints(o), freeze.endpoints(n)).collect()
    assert sorted((r["method"] or "", r["path"], r["origin"]) for r in ends) == [("", "/n", "old"), ("GET", "/a", "old"), ("PUT", "/b", "new"), ("PUT", "/b", "new")]
    assert freeze.freeze_counts(freeze.modules(o), freeze.models(o)).first().asDict() == {"modules": 2, "models": 2}
    assert freeze.api_style(o).first()[0] == "REST" and freeze.api_style(n).first()[0] == "RPC"


def test_last_of_equal_names_counts(spark):
    d = design(spark, {"modules": [{"name": "a", "public_api": ["x"]}, {"name": "a", "public_api": ["y"]}, {"responsibility": "r"}]})
    assert {r["name"]: r["public_api"] for r in freeze.modules(d).collect()} == {"a": ["y"], "unknown": []}


def test_context(spark):
    d = design(spark, {"tech_stack": {"language": "Python", "cache": "", "other": ["x", "y"]}, "coding_standards": {"max_line_length": 99, "require_docstrings": False}, "architecture": {"layers": [{"name": "a", "forbidden_dependencies": ["b", "b"], "allowed_dependencies": ["c"]}, {"name": "d", "forbidden_dependencies": ["a"]}]}}, {})
    rows = documents.context(d).collect()
    full = next(r for r in rows if r["tech_stack"])
    assert full["tech_stack"] == {"language": "Python", "other_tools": "x, y"}
    assert full["coding_standards"] == {"max_line_length": "99", "naming_style": "snake_case", "require_type_annotations": "True", "require_docstrings": "False", "error_handling_pattern": "try-except"}
    assert full["architecture_constraints"] == ["layer a must not depend on layer b", "layer d must not depend on layer a", "layer a may depend on layer c"]
    bare = next(r for r in rows if not r["tech_stack"])
    assert bare["coding_standards"] == {} and bare["architecture_constraints"] == [] and bare["frozen_specs"] is None
    with_spec = documents.context(d, spark.createDataFrame([("{}",)], "json string"))
    assert {r["frozen_specs"] for r in with_spec.collect()} == {"{}"}
    text = [r["markdown"] for r in documents.as_markdown(documents.context(d)).collect()]
    assert any("- language: Python" in t and "### Constraints" in t for t in text)


def test_define(spark):
    docs = [{"recommendation": {"reasoning": "r"}, "opportunity_windows": [{"suggested_approach": "go"}, {"suggested_approach": ""}, {}], "user_pain_points": [{"pain_point": "p"}, {}]}, {}]
    rows = documents.define(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string")).collect()
    assert sorted((r["product_goal"], r["core_features"], r["pain_points_addressed"]) for r in rows) == [("", [documents.NO_FEATURES], []), ("r", ["go"], ["p", ""])]


@pytest.mark.parametrize(
    "content, want",
    [('{"a": 1}', '{"a": 1}'), ('x\n```json\n{"a": 2}\n```', '{"a": 2}'), ("```\nno\n```\n```\n[3]\n```", "[3]"), ("```json\nbad\n```\n```\n{}\n```", "{}"), ("nothing", None), ("```json {\"a\": 1}", None), ("", None)],
)
def test_json_in_answers(spark, content, want):
    r = documents.extract_json(spark.createDataFrame([(content,)], "content string")).first()
    assert r["json"] == want or (want is None and r["error"] == content.strip()[:500]) or r["json"] is not None and json.loads(r["json"]) == json.loads(want)


def test_canonical_hash(spark):
    docs = ['{"b": 1, "a": "é"}', "[1.50, null]", "bad", None]
    want = [hashlib.sha256(json.dumps(json.loads(d), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12] for d in docs[:2]] + [None, None]
    assert [r["hash"] for r in documents.canonical_hash(spark.createDataFrame([(d,) for d in docs], "json string")).collect()] == want


def test_workspace_documents(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (b / "design.json").write_text('{"x": 1}')
    (a / "research.json").write_text("{bad")
    (a / "frozen_spec.json").write_text("{}")
    (a / "design.json").write_text('{"x": 2}')
    assert workspace.read_document(spark, "design.json", str(a), str(b)).first()[0] == '{"x": 2}'
    assert workspace.read_document(spark, "none.json", str(a), required=False).first()[0] == "{}"
    with pytest.raises(FileNotFoundError):
        workspace.read_document(spark, "none.json", str(a))
    assert [r["file_name"] for r in workspace.read_context_files(spark, str(a)).collect()] == ["design.json", "frozen_spec.json"]
    assert workspace.read_context_files(spark, str(tmp_path)).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    workspace.write_document(df, f"{tmp_path}/d.json")
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": 1, "b": "é"} and "\n  " in (tmp_path / "d.json").read_text()
    workspace.append_json_lines(df, f"{tmp_path}/log")
    workspace.append_json_lines(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    assert workspace.as_json_lines(df).first()[0] == '{"a":1,"b":"é"}'
    bundle = spark.createDataFrame([(json.dumps({"files": [{"path": "x/y.py", "content": "p"}, {"path": "../up.py", "content": "p"}, {"path": "/abs", "content": "p"}, {"path": "", "content": "p"}]}),)], "json string")
    got = {r["path"]: r["written"] for r in workspace.write_generated(documents.generated_files(bundle), f"{tmp_path}/gen").collect()}
    assert got == {"x/y.py": True, "../up.py": False, "/abs": False, "": False}
    assert os.listdir(f"{tmp_path}/gen/x") == ["y.py"] and not (tmp_path / "up.py").exists()
    many = spark.createDataFrame([(f"f{i:02d}",) for i in range(23)], "path string")
    assert [r["path"] for r in documents.shown_files(many).collect()][-2:] == ["f19", "+3 more"]


def records(spark):
    return trace.make_records(spark.createDataFrame([("2024-01-01 00:00:00", "a", "m", 0.5, 10, "t", "s" * 600, None), ("2024-01-02 00:00:00", "a", "m", 0.1, 10, None, "later", "out")], "timestamp string, step string, model string, temperature double, max_tokens int, template string, summary string, output string").withColumn("timestamp", F.to_timestamp("timestamp")))


def test_log(spark, tmp_path):
    made = records(spark).orderBy("timestamp").collect()
    assert len(made[0]["input_summary"]) == 500 and made[0]["output_hash"] == "n/a" and made[1]["prompt_template_version"] == "unknown"
    assert made[1]["output_hash"] == hashlib.sha256(b"out").hexdigest()[:12] and made[0]["prompt_template_version"] == hashlib.sha256(b"t").hexdigest()[:8]
    (tmp_path / "trace.log").write_text('{"step": "a", "model": "1"}\n\nnot json\n{"step": "b", "model": "2"}\n')
    log = trace.read_trace(spark, f"{tmp_path}/trace.log")
    assert sorted(r["step"] for r in log.collect()) == ["a", "b"]
    trace_file = tmp_path / "more.log"
    trace_file.write_text('{"step": "a", "run": 7, "who": {"id": 1}, "parameters": {"max_tokens": 3}}\n[1]\n{"step": "b"}\n')
    got = {r["step"]: (r["extra"], r["parameters"]) for r in trace.read_trace(spark, str(trace_file)).collect()}
    assert got["a"][0] == {"run": "7", "who": '{"id":1}'} and got["a"][1]["max_tokens"] == 3 and got["b"][0] == {}
    last = trace.last_per_step(records(spark), "timestamp").collect()
    assert [(r["step"], r["input_summary"]) for r in last] == [("a", "later")]
    extra = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), ({"a": "1"}, None)], "record map<string,string>, extra map<string,string>")
    assert [r["record"] for r in trace.with_extra(extra).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"a": "1"}]


def test_streams(spark, tmp_path):
    records(spark).write.json(f"{tmp_path}/log")
    stream = live.trace_stream(spark, f"{tmp_path}/log")
    live.run_to_table(live.last_per_step_stream(stream), "last_steps", "complete", f"{tmp_path}/c1").awaitTermination(60)
    assert [(r["step"], r["input_summary"]) for r in spark.table("last_steps").collect()] == [("a", "later")]
    live.run_to_table(live.steps_by_window(live.trace_stream(spark, f"{tmp_path}/log")), "windows", "append", f"{tmp_path}/c2").awaitTermination(60)
    assert spark.table("windows").count() >= 1
    os.makedirs(f"{tmp_path}/src")
    with open(f"{tmp_path}/src/a.py", "w") as out:
        out.write("x\nprint(1)\n")
    live.run_to_table(live.matches_stream(live.file_stream(spark, f"{tmp_path}/src"), rules("SA-")), "hits", "append", f"{tmp_path}/c3").awaitTermination(60)
    time.sleep(0.1)
    assert [(r["line_no"], r["rule_id"]) for r in spark.table("hits").collect()] == [(2, "SA-PY-2")]
