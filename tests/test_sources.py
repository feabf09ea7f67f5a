"""Prose ranges, tokens, files, reports and streaming."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from narae.functions import hangul
from narae.functions.catalogue import RULES, Config
from narae.operators.detect import lint
from narae.sources import files
from narae.sources.ranges import is_identifier, prose_ranges
from narae.sources.tokens import tokens_of
from narae.streaming.linting import byte_edit, documents, edited, watch


def prose(text, kind):
    return [text[a:b] for a, b in prose_ranges(text, kind)]


@pytest.mark.parametrize("kind, text, expected", [
    ("plain_text", "가 foo@bar.kr 나", ["가 ", " 나"]),
    ("plain_text", "(http://a.b/c), 나 #표 파일.txt은", ["(", "), 나 ", " "]),
    ("markdown", "가 `나` 다\n~~~\n라\n~~~\n마", ["가 ", " 다\n", "마"]),
    ("markdown", "    들여\n\t탭\n가", ["가"]),
    ("markdown", "가 ``나 ` 다\n라`` 마", ["가 ", " 마"]),
    ("markdown", "\\` 가` 나` 다", [" 가", " 다"]),
    ("markdown", "[가](b(c)d) 나 ![다](e)", ["[가]", " 나 ", "[다]"]),
    ("markdown", "[가](열린\n나", ["[가]", "나"]),
    ("markdown", "<http://가> 나 <가> 다", [" 나 <가> 다"]),
    ("markdown", "``` a`b\n가", []),  # no fence, as another backtick follows, but a code span that never closes
    ("python", "x = \"가 # 나\" # 다\n'''라 # 마''' # 바", ["# 다\n"[:-1], "# 바"]),
    ("python", "rb'가\\' # 나' # 다\n'열린 # 라\n# 마", ["# 다"]),
    ("rust", "/* 가 /* 나 */ 다 */ r#\"\"라\"# // 마", [" 가 ", " 나 ", " 다 ", " 마"]),
    ("rust", "fn f<'a>(x: &'a str) // 가\nlet c = '\\u{ac00}'; // 나", [" 가", " 나"]),
    ("javascript", "x = a / b / c // 가\ny = /[/]\\// // 나", [" 가", " 나"]),
    ("javascript", "`가 ${ f(`나 ${1 /* 다 */}`) } 라` // 마", [" 다 ", " 마"]),
    ("javascript", "if (x) /가/.test(y) // 나\n(x) / 2 // 다", [" 나", " 다"]),
    ("javascript", "'열린\n// 가", []),
])
def test_prose(kind, text, expected):
    assert prose(text, kind) == expected


def test_identifiers():
    assert all(is_identifier(t, True) for t in ("www.a", "a@b", "a/b", "a\\b", "a.txt", "a.txt를", "#가", "x://"))
    assert not any(is_identifier(t, True) for t in ("가.나", ".txt", "a." + "b" * 64, "#"))
    assert not is_identifier("#가", False)


def test_tokens():
    rows = tokens_of("😀가 가 가,나 ..끝.다", "plain_text")
    words = [(r[3], r[4], r[5], r[12]) for r in rows if r[2] == "word"]
    assert words == [(1, 4, "가", 0), (3, 8, "가", 1), (5, 12, "가", 2), (7, 16, "나", 0), (11, 22, "끝", 0), (13, 26, "다", 0)]


def test_syllables(spark):
    chars = "가힣값나a\u1100"
    rows = spark.createDataFrame([(c,) for c in chars], "c string").withColumn("p", hangul.parts(F.col("c")))
    rows = rows.withColumn("back", hangul.compose(F.col("p.initial"), F.col("p.medial"), F.col("p.final")))
    for r in rows.collect():
        assert r.back == (r.c if "가" <= r.c <= "힣" else None)
    pair = spark.createDataFrame([("가", "각"), ("가", "나"), ("강", "농"), ("a", "b"), ("가", "a")], "a string, b string")
    assert [r.d for r in pair.select(hangul.distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1, 1, 2, 1, 1]


def test_coordinates(spark):
    row = spark.createDataFrame([("😀가\n나다",)], "t string").select(
        hangul.line_of(F.col("t"), F.lit(4)).alias("line"), hangul.column_of(F.col("t"), F.lit(4)).alias("column"), hangul.byte_offset(F.col("t"), F.lit(2)).alias("bytes"), hangul.utf16_length(F.col("t")).alias("units"),
        hangul.changed_span(F.lit("abcd"), F.lit("abxd")).alias("s"), hangul.changed_span(F.lit("aa"), F.lit("aaa")).alias("t"),
    ).first()
    assert (row.line, row.column, row.bytes, row.units) == (2, 2, 7, 6)
    assert tuple(row.s) == (2, 3, "c", "x") and tuple(row.t) == (2, 2, "", "a")


def test_scan(spark, tmp_path):
    (tmp_path / "a.md").write_text("몇일")
    (tmp_path / "b.py").write_text("# 몇일")
    (tmp_path / "c.bin").write_text("x")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "e.js").write_text("// 몇일")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "f.txt").write_text("몇일")
    found = files.scan(spark, str(tmp_path), ["skip/", "# note"]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.source_kind) for r in found) == [("a.md", "markdown"), ("b.py", "python")]


def test_reports(spark):
    docs = spark.createDataFrame([(1, "가\n 몇일")], "doc_id long, text string")
    found = files.with_lines(lint(docs), docs).withColumn("path", F.lit("a b/c.md")).withColumn("message", F.lit("m"))
    assert files.report_lines(found).first().value == "a b/c.md:2:2: error [spelling.lexical.myeochil] m → 며칠"
    log = json.loads("".join(files.sarif(found, list(RULES.values()))))
    assert len(log["runs"][0]["tool"]["driver"]["rules"]) == 116 and json.loads("".join(files.sarif(found.limit(0))))["runs"][0]["results"] == []
    result = log["runs"][0]["results"][0]
    assert log["version"] == "2.1.0" and result["level"] == "error"
    assert result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a%20b/c.md"
    paths = {"/a b/é~*.md": "file:///a%20b/%C3%A9~%2A.md", "C:\\x\\y.md": "file:///C:/x/y.md", "//host/s.md": "file://host/s.md", "a:b.md": "a%3Ab.md"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.artifact_uri(F.col("p")).alias("u"))
    assert {r.p: r.u for r in rows.collect()} == paths
    assert files.fails(found, "error") and not files.fails(found.limit(0))


def test_feedback_and_diff(spark):
    lines = spark.createDataFrame([('{"ruleId": "a", "other": 1}',), ("{bad",), ('{"original": "x"}',)], "value string")
    assert [r.ruleId for r in files.feedback(lines).collect()] == ["a"]
    row = spark.range(1).select(files.line_diff(F.lit("a\nb"), F.lit("a\nc\nd")).alias("d")).first()
    assert [(x.line, x.before, x.after) for x in row.d] == [(2, "b", "c"), (3, None, "d")]


def test_verified(spark, tmp_path):
    import hashlib

    path = tmp_path / "c.jsonl"
    path.write_text('{"id": "1", "text": "가"}\n\n{"id": "2", "text": "나"}\n')
    assert files.verified(spark, str(path), hashlib.sha256(path.read_bytes()).hexdigest()).count() == 1
    with pytest.raises(ValueError):
        files.verified(spark, str(path), "0" * 64)
    assert sorted(r.id for r in files.read_corpus(spark, str(path)).collect()) == ["1", "2"]


def test_edits():
    changes = pd.DataFrame([(1, 0, 1, 0, 3, "x"), (2, None, None, None, None, "둘\n셋"), (3, 1, 0, 1, 1, "넷")], columns=["version", "start_line", "start_character", "end_line", "end_character", "text"])
    assert edited("a😀b", changes.iloc[:1]) == "axb"
    assert edited("a😀b", changes) == "둘\n넷"
    assert byte_edit("가나", 3, 6, "x") == "가x"
    for a, b in ((1, 3), (0, 7), (4, 3)):
        with pytest.raises(ValueError):
            byte_edit("가나", a, b, "")


def test_streams(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "몇일"), (2, "좋다")], "doc_id long, text string").write.parquet(folder)
    query = watch(spark, folder, "doc_id long, text string", lambda found, n: out.extend(r.rule_id for r in found.collect()), Config(), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert out == ["spelling.lexical.myeochil"]

    changes = str(tmp_path / "edits")
    spark.createDataFrame([("u", 1, None, None, None, None, "가나"), ("u", 2, 0, 0, 0, 1, "다")], "uri string, version long, start_line int, start_character int, end_line int, end_character int, text string").write.parquet(changes)
    stream = documents(spark.readStream.schema(spark.read.parquet(changes).schema).parquet(changes))
    running = stream.writeStream.outputMode("update").format("memory").queryName("edited_documents").trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert [tuple(r) for r in spark.table("edited_documents").collect()] == [("u", 2, "다나")]
