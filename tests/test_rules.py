"""The rule fixtures, the guards, and parity with Python's patterns."""

import random
import re
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveline.functions.text import pattern, sanitise, shorten_list, snippet, stem, strip, suffix
from sieveline.operators.match import match, unprotected_routes
from sieveline.operators.rules import SUFFIXES, all_rules, catalogue, facts

LINE = "path string, file_name string, suffix string, line_no int, line string"


def cases():
    text = (Path(__file__).parent.parent / "FIXTURES.md").read_text()
    block = text[text.index("```text\nSA-PY-1") + 8 :]
    return [row.split(" ¦ ", 3) for row in block[: block.index("\n```")].split("\n")]


def lines_of(spark, rows):
    """rows of (file name, line)"""
    return spark.createDataFrame([(f"d/{i}/{name}", name, "." + name.rsplit(".", 1)[1], 1, line) for i, (name, line) in enumerate(rows)], LINE)


def test_every_rule_has_a_hit_and_a_miss():
    seen = {(r, k) for r, k, *_ in cases()}
    assert len(all_rules()) == 55
    assert all((r.rule_id, "hit") in seen and ({(r.rule_id, "miss"), (r.rule_id, "guard")} & seen) for r in all_rules())


def test_fixtures(spark):
    every = cases()
    found = {(int(r["path"].split("/")[1]), r["rule_id"]) for r in match(lines_of(spark, [(n, line) for *_, n, line in every]), all_rules()).collect()}
    wrong = [c for i, c in enumerate(every) if ((i, c[0]) in found) != (c[1] == "hit")]
    assert wrong == []


def test_patterns_match_what_pythons_match(spark):
    rng = random.Random(2)
    parts = ["execute(", "'", '"', "%s", "f", "+", " ", "\t", "token", "SECRET", "=", "abcdefgh", "../", "open(", "log", "password", " ", "　", " ", "\r", "é", "ſ", "K", "eval (", "os.system(", "http://", "localhost", "api", "if ", "==", "True", "None", "except", ":", "pickle.load(", "aws_", "key", "print("]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, line string")
    got = df.select("i", *[F.col("line").rlike(pattern(r.regex, r.ignore_case)).alias(r.rule_id) for r in all_rules()]).collect()
    for row in got:
        for r in all_rules():
            assert row[r.rule_id] == bool(re.search(r.regex, texts[row["i"]], re.I if r.ignore_case else 0)), (r.rule_id, texts[row["i"]])


def test_needs_skip_no_match(spark):
    """Rules find the same without the substrings that let them skip lines."""
    rng = random.Random(7)
    parts = ["execute(", "EXECUTE (", "'", '"', "%s", "f'", "+", " = ", "toKen", "ſecret", "SECRET", "paſſword", "PASSWORD", "apİkey", "apıkey", "API_KEY", "abcdefgh", "log", "LOG ", "credıt", "CREDİT", "credit", "aws_", "AWS_", "kEy", "print", "rawQuery(", "private_Key"]
    rows = [(".py", "".join(rng.choices(parts, k=rng.randint(1, 8)))) for _ in range(4000)] + [("." + n.rsplit(".", 1)[1], line) for *_, n, line in cases()]
    df = lines_of(spark, [("a" + s, line) for s, line in rows])
    found = lambda some: {(r["path"], r["rule_id"]) for r in match(df, some).collect()}
    quick = found(all_rules())
    assert quick == found([replace(r, needs=()) for r in all_rules()]) and len({r for _, r in quick}) == 55


def test_routes_without_protection(spark):
    rows = [("a.py", 1, "@app.route('/')"), ("a.py", 2, "x"), ("b.py", 1, "@router.get"), ("b.py", 2, "@login_required"), ("c.js", 1, "@app.route"), ("d.py", 1, "@permission"), ("e.py", 1, "@app.route"), ("e.py", 2, "@router.x")]
    df = spark.createDataFrame([(p, p, "." + p[-2:].lstrip("."), n, line) for p, n, line in rows], LINE)
    assert sorted((r["path"], r["line_no"]) for r in unprotected_routes(df).collect()) == [("a.py", 1), ("e.py", 1), ("e.py", 2)]


def test_catalogue_is_whole(spark):
    assert catalogue(spark).count() == len(facts()) == 61
    assert {f[0] for f in facts()} >= {r.rule_id for r in all_rules()}
    assert set(SUFFIXES["audit"]) > set(SUFFIXES["security"]) > set(SUFFIXES["static"])


@pytest.mark.parametrize("name, want", [("a.py", ".py"), (".env", ""), ("a.", ""), ("..py", ".py"), ("x.tar.gz", ".gz"), ("py", ""), ("a.PY", ".PY")])
def test_suffixes(spark, name, want):
    row = spark.createDataFrame([(name,)], "n string").select(suffix(F.col("n")).alias("s"), stem(F.col("n")).alias("t")).first()
    assert row["s"] == want and row["t"] == name.removesuffix(want)


def test_text_functions(spark):
    odd = ["  a b　", " x\x1c", "", "\t" + "é" * 200, "a\x00\x08b�"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string").select("i", strip(F.col("s")).alias("t"), snippet(F.col("s")).alias("p"), sanitise(F.col("s")).alias("c")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [s.strip() for s in odd] and [r["p"] for r in rows] == [s.strip()[:120] for s in odd]
    assert rows[4]["c"] == "ab"
    lists = spark.createDataFrame([(list("abcdefghijkl"),), (["a"],)], "x array<string>").select(shorten_list(F.col("x")).alias("x")).collect()
    assert sorted(len(r["x"]) for r in lists) == [1, 11]
