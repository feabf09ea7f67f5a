"""Authoring, policies, the JSON form and the command line."""

import json

from narae import api
from narae.__main__ import main
from narae.operators import authoring, candidates
from narae.operators.detect import lint
from narae.functions.catalogue import Config
from narae.sources.tokens import tokens


def test_romanised(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("며칠",), ("웹 브라우저",), ("값 A-1!",), ("",)], "t string").select(authoring.romanised(F.col("t")).alias("r"))
    assert [r.r for r in rows.collect()] == ["myeochil", "wep-beuraujeo", "gaps-a-1", ""]


def test_smoke_corpus_is_found(spark):
    from pyspark.sql import functions as F

    cases = authoring.smoke_corpus(spark).withColumn("doc_id", F.xxhash64("id"))
    found = {}
    for r in lint(cases.select("doc_id", "text"), Config("editorial")).collect():
        found.setdefault(r.doc_id, []).append(r.rule_id)
    for case in cases.collect():
        assert set(case.expected_rule_ids) <= set(found.get(case.doc_id, [])), case.id


def test_bundles_and_reports(spark):
    import hashlib

    described = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", "0" * 64), ("c", "0" * 64)], "name string, sha256 string")
    content = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "name string, content binary")
    assert {(r.name, r.problem) for r in authoring.bundle_problems(described, content).collect()} == {("b", "digest"), ("c", "missing")}
    metrics = spark.createDataFrame([(0.5,)], "precision double")
    report = authoring.gate_report(metrics, metrics.where("precision < 0"))
    assert report["passed"] and report["metrics"] == {"precision": 0.5}


def test_benchmark_texts(spark):
    rows = authoring.benchmark_texts(spark, {"small": 200, "large": 1000}).collect()
    assert len(rows) == 6 and all(len(r.text.encode()) == r.byte_length for r in rows)


def test_plans_and_lexicons(spark):
    docs = spark.createDataFrame([(1, "몇일 데이터베이스 만날때")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("며칠", "n", 5), ("데이터", "n", 9), ("베이스", "n", 9), ("만날", "v", 3), ("때", "n", 8)], "surface string, pos string, freq long")
    found, extra = api.lint_with_lexicon(spark, docs, lexicon)
    more = {r.original: r.suggestions for r in extra.collect()}
    assert more["데이터베이스"] == ["데이터 베이스"] and "며칠" not in more["몇일"]  # what a rule suggests already
    words = tokens(docs).where("kind = 'word'")
    plan = candidates.correction_plan(candidates.split_candidates(words, lexicon)).first()
    assert [e.original for e in plan.edits] == ["데이터베이스", "만날때"]


def test_json_form(spark):
    out = json.loads(api.lint_json(spark, json.dumps({"text": "몇일 문서를 문서를", "config": {"profile": "strict", "disabledRules": ["x"], "unknown": 1}})))
    assert [d["rule_id"] for d in out["diagnostics"]] == ["spelling.lexical.myeochil", "repetition.adjacent-word"]
    assert out["diagnostics"][0]["suggestions"][0]["safety"] == "safe"
    assert (out["fixedText"], out["reviewFixedText"]) == ("며칠 문서를 문서를", "며칠 문서를")
    assert json.loads(api.rule_catalogue_json())["ruleCount"] == 116


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("좋은 글")
    assert main([str(tmp_path)]) == 0
    (tmp_path / "b.md").write_text("몇일")
    assert main([str(tmp_path), "--format", "sarif"]) == 1 and '"spelling.lexical.myeochil"' in capsys.readouterr().out
    assert main([str(tmp_path)]) == 1 and "b.md:1:1: error" in capsys.readouterr().out
    assert main([]) == 2 and main(["--explain", "none"]) == 2 and main(["--explain", "grammar.ending.sipsio"]) == 0 and main(["--rules"]) == 0
