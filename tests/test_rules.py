"""The catalogue's contract: what a rule corrects is found, the correction is quiet and stable."""

import pytest

from narae.functions.catalogue import RULES, Config, lexicon, overlay, rule_pack
from narae.functions.rule_tables import CONDITIONAL, FORMS, LITERALS
from narae.operators.detect import COLUMNS, lint, pack_findings
from narae.operators.fix import fix, fix_once, lint_with_fixes, preview

ALL = Config("editorial")
DOCS = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_catalogue_size():
    assert len(RULES) == 116
    assert sum(r.safety == "safe" for r in RULES.values()) == 96
    assert list(RULES) == sorted(RULES)


def test_patterns_do_not_contain_each_other_and_few_have_borders():
    wrong = [a for _, _, _, _, pairs in LITERALS for a, _ in pairs] + [f[2] for f in FORMS]
    assert not [(a, b) for a in wrong for b in wrong if a != b and a in b]
    assert {a for a in wrong if any(a.startswith(a[-k:]) for k in range(1, len(a)))} == {",,", "를를", "을을", "은은", "는는"}


def test_each_literal_is_found_and_its_correction_is_quiet(spark):
    pairs = [(name, a, b, safety) for name, _, _, safety, ps in LITERALS for a, b in ps] + [(n, a, b, "safe") for n, _, a, b in FORMS if n != "grammar.particle.duplicate" and a[0] != " "]
    texts = [f"글 {a} 글" for _, a, _, _ in pairs] + [f"글 {b} 글" for _, _, b, _ in pairs]
    found = {(r.doc_id, r.rule_id, r.original, r.suggestion) for r in lint(docs(spark, texts), ALL).collect()}
    for k, (name, a, b, _) in enumerate(pairs):
        assert (k, name, a, b) in found, name
        assert not any(i == k + len(pairs) and rule == name for i, rule, _, _ in found), name


def test_findings_across_wide_gaps(spark):
    from narae.operators.candidates import join_candidates
    from narae.sources.tokens import tokens

    wide = " " * 38 + "\n\u3000"
    table = docs(spark, [f"그는 학교{wide}학교 앞", f"잊을리가{wide}없다", f"사과{wide}나무", f"잊을리가{wide}있다"])
    found = {(r.doc_id, r.rule_id): r for r in lint(table, ALL).collect()}
    twice = found[0, "repetition.adjacent-word"]
    assert (twice.original, twice.start, twice.end, twice.byte_end) == (f"학교{wide}학교", 3, 47, 7 + 6 + 42 + 6)
    assert (1, "spacing.dependent-noun.ri") in found and (3, "spacing.dependent-noun.ri") not in found
    lexicon_ = spark.createDataFrame([("사과나무", 5)], "surface string, freq long")
    pair = join_candidates(tokens(table).where("kind = 'word'"), lexicon_).first()
    assert (pair.doc_id, pair.original, pair.start, pair.end) == (2, f"사과{wide}나무", 0, 44)


def test_each_conditional_rule_is_found(spark):
    follow = {"spacing.dependent-noun.ri": "잊을리가 없다"}
    texts = [follow.get(name, wrong) for name, _, _, _, wrong, _ in CONDITIONAL]
    found = {(r.doc_id, r.rule_id) for r in lint(docs(spark, texts), ALL).collect()}
    for k, row in enumerate(CONDITIONAL):
        assert (k, row[0]) in found, row[0]


def test_ranges_reproduce_originals(spark):
    texts = ["😀 몇일 전 되서 .", "사과,배\r\n몇일\t끝났다.다음", "문서를  문서를 책를"]
    for r in lint(docs(spark, texts), ALL).collect():
        text = texts[r.doc_id]
        assert text[r.start : r.end] == r.original
        assert text.encode()[r.byte_start : r.byte_end].decode() == r.original


def test_safe_fixes_are_stable(spark):
    texts = [f"글 {a} 글" for _, _, _, safety, ps in LITERALS if safety == "safe" for a, _ in ps] + ["되서 됬고 할수 있다 ,,가 끝 .다음"]
    once = fix(docs(spark, texts)).select("doc_id", "fixed").collect()
    again = {r.doc_id: r.fixed for r in fix(docs(spark, [r.fixed for r in sorted(once)])).collect()}
    assert all(again[r.doc_id] == r.fixed for r in once)


def test_nulls_and_empty_texts(spark):
    rows = docs(spark, [None, "", " "])
    assert lint(rows, ALL).count() == 0
    assert {r.doc_id: r.fixed for r in fix(rows).collect()} == {0: None, 1: "", 2: " "}
    empty = spark.createDataFrame([], DOCS)
    assert lint(empty, ALL).columns == COLUMNS and fix(empty).count() == 0


def test_profiles_and_disabled_rules(spark):
    rows = docs(spark, ["찌게 가장 최고 책를"])
    assert lint(rows).count() == 0
    assert {r.rule_id for r in lint(rows, Config("strict")).collect()} == {"spelling.lexical.jjigae", "grammar.particle.object-allomorph"}
    assert lint(rows, Config("strict", frozenset({"spelling.lexical.jjigae"}))).count() == 1


def test_disabled_commas_fall_through(spark):
    rows = docs(spark, ["가,,나"])
    found = lint(rows, Config(disabled=frozenset({"punctuation.duplicate.comma"}))).collect()
    assert [(r.rule_id, r.start, r.end, r.suggestion) for r in found] == [("punctuation.space-after-comma", 2, 3, ", ")]


def test_dictionary_words(spark):
    rows = docs(spark, ["몇일 메세지 되서"])
    found = lint(rows, Config(dictionary=frozenset({"몇일"}), overlay={"메세지": "noun", "되서": "verb"})).collect()
    assert [r.rule_id for r in found] == ["grammar.conjugation.doe-to-dwae"]


def test_an_unsafe_finding_does_not_block_a_safe_one(spark):
    rows = docs(spark, ["문서를 문서를 됬다"])
    found = lint(rows)
    assert fix_once(rows, found).first().fixed == "문서를 문서를 됐다"
    assert fix_once(rows, found, review=True).first().fixed == "문서를 됐다"
    assert preview(rows, found).first().fixed == "문서를 됐다"


def test_cycles_keep_the_original(spark):
    pack = rule_pack({"version": 1, "language": "ko", "rules": [
        {"id": "p.a", "severity": "info", "message": "m", "safe_fix": True, "replacements": [{"from": "alpha", "to": "beta"}]},
        {"id": "p.b", "severity": "info", "message": "m", "safe_fix": True, "replacements": [{"from": "beta", "to": "alpha"}]},
        {"id": "p.c", "severity": "info", "message": "m", "safe_fix": True, "replacements": [{"from": "one", "to": "two"}, {"from": "two", "to": "three"}]},
    ]})
    out = {r.doc_id: r.fixed for r in fix(docs(spark, ["alpha", "one", "x"]), rules=pack).collect()}
    assert out == {0: "alpha", 1: "three", 2: "x"}


def test_growing_rewrites_keep_the_original(spark):
    pack = rule_pack({"version": 1, "language": "ko", "rules": [{"id": "p.g", "severity": "info", "message": "m", "safe_fix": True, "replacements": [{"from": "grow", "to": "growgrow", "boundary": "prefix"}]}]})
    from narae.operators import fix as module

    module.MOST_PASSES, before = 3, module.MOST_PASSES
    try:
        assert fix(docs(spark, ["grow"]), rules=pack).first().fixed == "grow"
    finally:
        module.MOST_PASSES = before


def test_pack_boundaries(spark):
    rules = {b: rule_pack({"version": 1, "language": "ko", "rules": [{"id": f"p.{b}", "severity": "info", "message": "m", "replacements": [{"from": "ab", "to": "x", "boundary": b}]}]}) for b in ("substring", "word", "prefix", "suffix")}
    rows = docs(spark, ["ab xab abx xabx _ab ab1 가ab (ab)"])
    starts = {b: sorted(r.start for r in pack_findings(rows, p).collect()) for b, p in rules.items()}
    assert starts == {"substring": [0, 4, 7, 12, 17, 20, 25, 29], "word": [0, 29], "prefix": [0, 7, 20, 29], "suffix": [0, 4, 17, 25, 29]}


def test_self_overlapping_packs(spark):
    pack = rule_pack({"version": 1, "language": "ko", "rules": [{"id": "p.o", "severity": "info", "message": "m", "replacements": [{"from": "aa", "to": "a"}]}]})
    assert sorted(r.start for r in pack_findings(docs(spark, ["aaaaa"]), pack).collect()) == [0, 2]


@pytest.mark.parametrize("change", [{"version": 2}, {"language": "en"}, {"rules": []}])
def test_bad_packs(change):
    good = {"version": 1, "language": "ko", "rules": [{"id": "p", "severity": "info", "message": "m", "replacements": [{"from": "a", "to": "b"}]}]}
    rule_pack(good)
    with pytest.raises(ValueError):
        rule_pack(good | change)


@pytest.mark.parametrize("change", [{"id": "spelling.lexical.geumse"}, {"message": " "}, {"replacements": []}, {"replacements": [{"from": "", "to": "b"}]}, {"replacements": [{"from": "a", "to": "b"}, {"from": "a", "to": "c"}]}, {"severity": "loud"}])
def test_bad_pack_rules(change):
    rule = {"id": "p", "severity": "info", "message": "m", "replacements": [{"from": "a", "to": "b"}]}
    with pytest.raises(ValueError):
        rule_pack({"version": 1, "language": "ko", "rules": [rule | change]})


def test_overlays_and_lexicons():
    assert overlay("narae-overlay-v1\n가\tnoun\n\n가\tverb") == {"가": "verb"}
    assert lexicon("narae-lexicon-v1\n가\tnoun\t3\n나\tnoun\t4") == [("가", "noun", 3), ("나", "noun", 4)]
    for bad in ("가\tnoun\t3", "narae-lexicon-v1\n나\tn\t1\n가\tn\t1", "narae-lexicon-v1\n가\tn", "narae-lexicon-v1\n가\tn\tx", "narae-lexicon-v1\n가\tn\t1\n가\tn\t1"):
        with pytest.raises(ValueError):
            lexicon(bad)
    with pytest.raises(ValueError):
        overlay("가\tnoun")


def test_lint_with_fixes(spark):
    row = lint_with_fixes(docs(spark, ["몇일 문서를 문서를"])).first()
    assert row.fixed_text == "며칠 문서를 문서를" and row.review_fixed_text == "며칠 문서를"
    assert [d.rule_id for d in row.diagnostics] == ["spelling.lexical.myeochil", "repetition.adjacent-word"]
