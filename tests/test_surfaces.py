"""Scans, the command line, the standard pipeline, corpus runs and file streams, end to end."""

import io
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import narae
from narae.__main__ import command, main
from narae.functions.catalogue import Config
from narae.operators import curate, evaluate, standard
from narae.operators.candidates import near_words
from narae.operators.detect import lint
from narae.operators.fix import accepted, applied, standing
from narae.sources import files
from narae.streaming.linting import watch_configurations, watch_files

LEXICON = [("데이터", "n", 9), ("베이스", "n", 9), ("만날", "v", 3), ("때", "n", 8), ("문서", "n", 7), ("문장", "n", 6), ("며칠", "n", 5)]


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "surface string, pos string, freq long")


def test_scan_reads_ignore_files(spark, tmp_path):
    made = {
        ".gitignore": "*.log.md\n/only_here.md\nskip/\n# note\n!kept.log.md\ndeep/**/x.md\n", "a.md": "글", "b.log.md": "글", "kept.log.md": "글", "only_here.md": "글", ".hidden/c.md": "글", "skip/d.md": "글",
        "sub/only_here.md": "글", "sub/.naraeignore": "e*.txt\n!kept/\n", "sub/e1.txt": "글", "sub/f.txt": "글", "deep/1/2/x.md": "글", "deep/1/y.md": "글", "node_modules/z.js": "글", "build/k.py": "# 글", "n.bin": "글",
    }
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.md").write_bytes(b"\xff")
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    found = {r.path.split(str(tmp_path) + "/")[1] for r in files.scan(spark, str(tmp_path)).collect()}
    assert found >= {"a.md", "kept.log.md", ".hidden/c.md", "sub/only_here.md", "sub/f.txt", "deep/1/y.md", "build/k.py"}
    assert not found & {"b.log.md", "only_here.md", "skip/d.md", "sub/e1.txt", "deep/1/2/x.md", "node_modules/z.js", "bad.md", "n.bin"}
    with pytest.raises(ValueError):
        files.named(spark, [str(tmp_path / "bad.md")])


def test_corpus_errors_name_the_line(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1"}\n\n{"id": \n')
    with pytest.raises(ValueError, match="c.jsonl:3"):
        files.read_corpus(spark, str(tmp_path / "c.jsonl"))


def test_corrections_in_place(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "a b.md"
    path.write_text("몇일 좋다\n둘")
    path.chmod(0o640)
    (tmp_path / "c.md").write_text("좋다")
    assert main([str(tmp_path), "--fix", "--dry-run"]) == 1 and "+ 며칠 좋다" in capsys.readouterr().out and path.read_text() == "몇일 좋다\n둘"
    assert main([str(tmp_path), "--fix"]) == 0 and path.read_text() == "며칠 좋다\n둘" and path.stat().st_mode & 0o777 == 0o640
    assert sorted(os.listdir(tmp_path)) == ["a b.md", "c.md"] and main([str(tmp_path)]) == 0
    monkeypatch.setattr("sys.stdin", io.StringIO("몇일"))
    assert main(["--stdin"]) == 1 and "<stdin>:1:1" in capsys.readouterr().out
    assert main([str(tmp_path / "none.md")]) == 2


def test_small_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert command("init", []) == 0 and command("init", []) == 2 and command("doctor", []) == 0
    (tmp_path / ".narae.json").write_text(json.dumps({"disabledRules": ["no.such.rule"]}))
    assert command("doctor", []) == 1 and "no.such.rule" in capsys.readouterr().out
    (tmp_path / "d.json").write_text(json.dumps({"entries": [{"surface": "가", "pos": "n"}]}))
    assert command("dictionary-validate", ["d.json"]) == 0 and command("dictionary-validate", [".narae.json"]) == 1
    assert command("completion", []) == 0 and "--fail-on" in capsys.readouterr().out
    assert main(["--rules", "--format", "markdown"]) == 0 and "## `spelling.lexical.myeochil`" in capsys.readouterr().out
    assert set(narae.__all__) <= set(dir(narae))


def test_standard_pipeline(spark, lexicon):
    docs = spark.createDataFrame([(1, "몇일 데이터베이스 문쟝"), (2, "때"), (3, None)], "doc_id long, text string")
    trace = standard.Trace()
    found = {(r.original, r.safety): r for r in standard.standard_findings(docs, lexicon, trace=trace).collect()}
    assert found.keys() == {("몇일", "safe"), ("몇일", "review"), ("데이터베이스", "review"), ("문쟝", "review")}
    first = {k: r.suggestions[0].text for k, r in found.items()}
    assert first["몇일", "safe"] == "며칠" and first["데이터베이스", "review"] == "데이터 베이스" and first["문쟝", "review"] == "문장"
    assert "며칠" not in {c.text for c in found["몇일", "review"].suggestions}  # what a rule suggests already
    assert {c.text for c in found["문쟝", "review"].suggestions} >= {"문장", "문서"} and found["문쟝", "review"].evidence[0].code == "edit-distance"
    seen = dict(trace.events())
    assert seen["rules"]["rows"] == 1 and seen["findings"]["rows"] == 4
    out = {r.doc_id: r for r in standard.standard(docs, lexicon).collect()}
    assert out[1].fixed_text == "며칠 데이터베이스 문쟝" and out[1].review_fixed_text == "때 데이터 베이스 문장" and out[2].review_fixed_text == "때" and out[3].fixed_text is None
    answer = json.loads(narae.lint_standard_json(spark, json.dumps({"text": "몇일 문쟝", "includeReview": False}), lexicon))
    assert answer["reviewFixedText"] == answer["fixedText"] == "며칠 문쟝" and len(answer["diagnostics"]) == 3
    none = standard.standard_findings(docs, lexicon, Config(disabled=frozenset({"spelling.lexical.candidate"}))).where("original = '문쟝'")
    assert none.count() == 0


def test_context_ranker(spark, lexicon):
    rng = np.random.default_rng(3)
    weights = rng.integers(-127, 128, 260).tolist()
    manifest = {"schema_version": 1, "feature_dim": 260, "feature_scale": 0.01, "weight_scale": 0.02, "bias": -0.1, "weights": weights}
    ranker = standard.ContextRanker.load(json.dumps(manifest))
    before, after = "가 나  다", "가 나 라라"
    grams = {}
    for marker, text in (("S", "가 나 다"), ("C", "가 나 라라")):
        for size in (1, 2, 3):
            for k in range(len(text) - size + 1):
                bucket = curate.fnv_bucket(f"{marker}:{text[k : k + size]}", size)
                grams[bucket] = grams.get(bucket, 0) + 1
    x = np.zeros(260)
    for bucket, n in grams.items():
        x[bucket] = n / sum(grams.values())
    x[256:] = [1, 1 - 4 / 6, np.log(7), 0]
    whole = np.clip(np.floor(np.abs(x) / 0.01 + 0.5) * np.sign(x), -127, 127)
    assert abs(ranker.of_texts(before, after) - (whole @ weights * 0.0002 - 0.1)) < 1e-4
    with pytest.raises(ValueError):
        standard.ContextRanker.load(json.dumps(manifest | {"feature_dim": 3}))
    answer = json.loads(narae.lint_context_json(spark, json.dumps({"text": "문쟝"}), lexicon, json.dumps(manifest)))
    assert {s["text"] for s in answer["diagnostics"][0]["suggestions"]} >= {"문장"}


def test_analysed_tokens(spark):
    ranges = spark.createDataFrame([(1, 0, 4), (1, 6, 9)], "doc_id long, start long, end long")
    found = spark.createDataFrame([(1, 0, 2, "n"), (1, 3, 5, "v"), (1, 6, 9, "j"), (1, 6, 9, "i"), (2, 0, 1, "n")], "doc_id long, start long, end long, pos string")
    assert sorted((r.start, r.pos) for r in standard.tokens_in_ranges(found, ranges).collect()) == [(0, "n"), (6, "i"), (6, "j")]
    words = spark.createDataFrame([(1, 0, "가나"), (1, 6, "가나다"), (1, 6, "가")], "doc_id long, start long, surface string")
    assert sorted((r.surface, r.pos) for r in standard.with_parts_of_speech(words, found).collect() if r.pos) == [("가나", "n"), ("가나다", "i")]


def test_near_words_equal_all_pairs(spark):
    import random

    rng = random.Random(7)
    make = lambda: "".join(rng.choice("가나다라마") for _ in range(rng.randint(1, 9)))
    entries, words = sorted({make() for _ in range(120)}), sorted({make() for _ in range(120)})
    lexicon = spark.createDataFrame([(w, "n", k + 1) for k, w in enumerate(entries)], "surface string, pos string, freq long")
    found = near_words(spark.createDataFrame([(w,) for w in words], "surface string"), lexicon).groupBy("word").agg(F.collect_set("replacement").alias("r")).collect()

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    expected = {w: {e for e in entries if abs(len(e) - len(w)) <= 1 and edits(w, e) <= 2} for w in words if len(w) > 1 and w not in entries}
    got = {r.word: set(r.r) for r in found}
    assert got.keys() == {w for w, e in expected.items() if e}
    assert all(r <= expected[w] and len(r) == min(32, len(expected[w])) for w, r in got.items())


def test_findings_that_still_stand(spark):
    docs = spark.createDataFrame([(1, "몇일 만날때")], "doc_id long, text string")
    found = lint(docs)
    later = spark.createDataFrame([(1, "x몇일 만날때")], "doc_id long, text string")
    assert found.count() > 0 and standing(docs, found).count() == found.count() and standing(later, found).count() == 0
    both = spark.createDataFrame([(1, 0, 2, "b", 0, "몇일", "며칠", True), (1, 0, 2, "a", 0, "몇일", "x", False)], "doc_id long, start long, end long, rule_id string, turn int, original string, suggestion string, safe boolean")
    assert applied(docs, accepted(both, True, ties="safe")).first().fixed == "며칠 만날때" and applied(docs, accepted(both, True)).first().fixed == "x 만날때"


def test_hinge_ranker():
    pairs = pd.DataFrame([(0.0, 1.0), (0.0, 0.5)], columns=["bias", "score"])
    w = curate.hinge_ranker(pairs, ["bias", "score"], epochs=2, step=0.1)
    expected = 0.0
    for _ in range(2):
        for x in (1.0, 0.5):
            expected += 0.1 * max(0.0, 1 - expected * x) * x
    assert w["bias"] == 1 and abs(w["score"] - expected) < 1e-12
    with pytest.raises(ValueError):
        curate.hinge_ranker(pairs.assign(split="release_holdout"), ["bias", "score"])
    assert curate.fnv_bucket("S:가", 1) == 0xCBF29CE484222325 * 0 + _fnv("1:S:가")


def _fnv(text):
    h = 14695981039346656037
    for b in text.encode():
        h = ((h ^ b) * 1099511628211) % 2**64
    return h % 256


def test_positional_split_of_sparse_ids(spark):
    rows = spark.createDataFrame([(k * 10**12 + 7,) for k in range(200)], "n long")
    out = {r.n: r.split for r in curate.positional_split(rows, "n").collect()}
    assert [out[k * 10**12 + 7] for k in range(200)] == ["train"] * 160 + ["dev"] * 20 + ["release_holdout"] * 20


def test_corpus_run(spark, tmp_path, capsys):
    cases = [
        {"id": "a", "text": "몇일", "caseType": "error", "expectedDiagnostics": [{"ruleId": "spelling.lexical.myeochil", "original": "몇일", "suggestions": ["며칠"]}], "expectedFixedText": "며칠"},
        {"id": "b", "text": "좋다", "caseType": "normal"}, {"id": "c", "text": "깨끗히", "caseType": "error", "expectedRuleIds": ["spelling.lexical.myeochil"]},
    ]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(json.dumps(c) for c in cases))
    report, passed = evaluate.corpus_report(files.read_corpus(spark, str(path)), {"recall": 0.4, "specificity": 1.0})
    assert passed and report["metrics"]["tp"] == 1 and report["metrics"]["fn"] == 1 and report["metrics"]["specificity"] == 1.0 and report["failures"] == {"findings": 1}
    (tmp_path / "gates.json").write_text(json.dumps({"recall": 0.9}))
    assert command("corpus", [str(path), str(tmp_path / "gates.json")], spark) == 1 and "failedGates" in capsys.readouterr().out


def test_files_and_configurations_that_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("몇일")
    (folder / "sub" / "b.py").write_text("# 몇일")
    (folder / "c.bin").write_text("몇일")
    out = []
    watch_files(spark, str(folder), lambda found, n: out.extend(r.path.rsplit("/", 1)[1] for r in found.collect())).awaitTermination(120)
    assert sorted(out) == ["a.md", "b.py"]
    settings = tmp_path / "settings"
    settings.mkdir()
    (settings / "one.json").write_text(json.dumps({"disabledRules": ["spelling.lexical.myeochil"]}))
    docs = lambda: spark.createDataFrame([(1, "몇일 문서를 문서를")], "doc_id long, text string")
    again = []
    watch_configurations(spark, str(settings), docs, lambda found, n: again.append(sorted(r.rule_id for r in found.collect()))).awaitTermination(120)
    assert again == [["repetition.adjacent-word"]]
