"""Metrics, candidates and curation on small tables."""

import math

from pyspark.sql import functions as F

from narae.operators import candidates, curate, evaluate


def test_matching_in_detail(spark):
    expected = spark.createDataFrame([("c", "r", None, None, None, None), ("c", "r", 5, 7, None, ["x"]), ("d", "s", None, None, "o", None)], "case_id string, rule_id string, start int, end int, original string, suggestions array<string>")
    actual = spark.createDataFrame([("c", "r", 5, 7, "ab", "x"), ("c", "r", 1, 2, "a", "y"), ("c", "q", 3, 4, "z", "w"), ("d", "s", 0, 1, "p", "x")], "case_id string, rule_id string, start int, end int, original string, suggestion string")
    found = {(r.case_id, r.rule_id): (r.tp, r.fp, r.fn) for r in evaluate.matched_in_detail(expected, actual).collect()}
    assert found == {("c", "r"): (2, 0, 0), ("c", "q"): (0, 1, 0), ("d", "s"): (0, 1, 1)}


def test_ranges_of_originals(spark):
    kinds = "case_id string, rule_id string, start int, end int, original string, suggestions array<string>"
    cases = spark.createDataFrame([("a", "가나 다나", "error", ["r"]), ("b", "aaa 가", "error", ["r"])], "case_id string, text string, case_type string, expected_rule_ids array<string>")
    for c in ("origin", "genre", "document_id", "split"):
        cases = cases.withColumn(c, F.lit(None).cast("string"))
    rows = [("a", "r", None, None, "다나", None), ("a", "r", None, None, "나", None), ("a", "r", None, None, "라", None), ("b", "r", None, None, "aa", None), ("b", "r", 4, 5, None, None), ("b", "r", 4, 7, "나", None)]
    rows += [("b", "r", 4, 7, "가", None), ("b", "r", 4, 99, None, None), ("b", "r", 3, 2, None, None), ("b", "r", None, None, "", None), ("b", "r", None, None, None, None), ("a", "r", 14, 14, None, None)]
    expected = spark.createDataFrame(rows, kinds)
    found = {(r.case_id, r.original, (r.start, r.end) if r.start is not None else None): r.problem for r in evaluate.resolved_ranges(expected, cases).collect()}
    assert found == {
        ("a", "다나", (7, 13)): None, ("a", "나", None): "repeated original", ("a", "라", None): "absent original", ("b", "aa", None): "repeated original", ("b", None, (4, 5)): "invalid range",
        ("b", "나", (4, 7)): "range is not the original", ("b", "가", (4, 7)): None, ("b", None, (4, 99)): "invalid range", ("b", None, (3, 2)): "invalid range", ("b", "", None): "empty original",
        ("b", None, None): None, ("a", None, (14, 14)): "invalid range",
    }
    assert sorted(r.problem for r in evaluate.corpus_problems(cases, expected).collect()) == sorted(p for p in found.values() if p)
    twice = spark.createDataFrame([("a", "r", 0, 6, "다나", "x")], "case_id string, rule_id string, start int, end int, original string, suggestion string")
    counts = evaluate.matched_in_detail(expected.where("original = '다나'"), twice, cases).first()
    assert (counts.tp, counts.fp, counts.fn) == (0, 1, 1)


def test_undefined_ratios_are_null(spark):
    counts = spark.createDataFrame([("c", "a", 0, 0, 2), ("c", "b", 0, 3, 0), ("c", "d", 4, 0, 0)], "case_id string, rule_id string, tp long, fp long, fn long")
    rules = {r.rule_id: r for r in evaluate.per_rule(counts).collect()}
    assert rules["a"].precision is None and rules["a"].recall == 0 and rules["b"].recall is None
    total = evaluate.totals(counts).first()
    assert (total.macro_precision, total.macro_recall) == (0.5, 0.5)
    z, n = evaluate.Z, 4
    assert math.isclose(rules["d"].precision_low, (1 + z * z / (2 * n) - z * math.sqrt(z * z / (4 * n) / n)) / (1 + z * z / n))
    empty = evaluate.totals(counts.limit(0)).first()
    assert empty.tp == 0 and empty.precision is None
    failed = {r.metric for r in evaluate.gate_failures(evaluate.totals(counts.limit(0)), [evaluate.Gate("precision", 0.5), evaluate.Gate("recall", 0.5, "tp", 1)]).collect()}
    assert failed == {"precision"}


def test_near_words(spark):
    words = spark.createDataFrame([(1, 0, "몇일", "", ""), (1, 3, "며칠", "", ""), (2, 0, "a", "", "")], "doc_id long, start long, surface string, ahead string, next string")
    lexicon = spark.createDataFrame([("며칠", "n", 10), ("몇", "n", 1), ("사과나무", "n", 1)], "surface string, pos string, freq long")
    found = {(r.word, r.replacement): (r.edits, r.sounds) for r in candidates.near_words(words, lexicon).collect()}
    assert found == {("몇일", "며칠"): (2, 4 - 1), ("몇일", "몇"): (1, 0)} or found[("몇일", "몇")] == (1, 0)
    merged = candidates.merged(candidates.spelling_candidates(words, lexicon), spark.createDataFrame([(1, 0, 2, "몇")], "doc_id long, start long, end long, suggestion string"))
    assert [r.suggestions for r in merged.collect()] == [["며칠"]]


def test_policy(spark):
    row = spark.range(1).select(
        candidates.policy(F.lit("spelling"), F.lit(True), F.lit("high"), F.lit(0.995), F.lit("plain")).alias("a"), candidates.policy(F.lit("spelling"), F.lit(True), F.lit("high"), F.lit(0.5), F.lit("plain")).alias("b"),
        candidates.policy(F.lit("style.x"), F.lit(True), F.lit("high"), F.lit(1.0), F.lit("plain")).alias("c"), candidates.policy(F.lit("spelling"), F.lit(False), F.lit("high"), F.lit(1.0), F.lit("plain")).alias("d"),
    ).first()
    assert tuple(row) == ("safe", "review", "review", "abstain")


def test_similar_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(60)) for _ in range(12)]
    texts = [(f"{k}-{j}", t[: 50 + j] + rng.choice(["", "x", "yz"]), "train" if j % 2 else "dev") for k, t in enumerate(base) for j in range(5)]
    rows = spark.createDataFrame(texts, "id string, text string, split string")
    sets = {i: {t.strip()[a : a + 5] for a in range(len(t.strip()) - 4)} for i, t, _ in [(i, " ".join(t.split()).lower(), s) for i, t, s in texts]}
    split = {i: s for i, _, s in texts}
    brute = {(a, b) for a in sets for b in sets if a < b and split[a] != split[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert {(r.left_id, r.right_id) for r in curate.similar_pairs(rows).collect()} == brute and brute


def test_revisions(spark):
    rows = spark.createDataFrame([("1", "d", "나는 몇일 쉬었다", "나는 며칠 쉬었다"), ("2", "d", "또 몇일 간다", "또 며칠 간다"), ("3", "d", "같다", "같다"), ("4", "d", "가", "나다라마")], "id string, document_id string, before string, after string")
    assert [(r.id, r.original, r.replacement) for r in curate.revisions(rows).collect()] == [("1", "몇일", "며칠")]


def test_annotations(spark):
    groups = spark.createDataFrame([("1", "S 나 는 간다 .\nA 0 1|||R:NOUN|||너|||REQUIRED|||-NONE-|||0\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||1"), ("2", "S 좋다 !\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0")], "id string, lines string")
    found = curate.annotations(groups)
    assert [(r.id, r.text) for r in curate.unchanged_cases(found).collect()] == [("2", "좋다!")]
    assert [(r.id, r.annotator, r.edits[0].correction) for r in curate.review_queue(found).collect()] == [("1", 0, "너")]


def test_adjudication(spark):
    queue = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    reviews = spark.createDataFrame([("1", "a", "c", "yes"), ("1", "b", "c", "yes"), ("2", "a", "a", "yes"), ("2", "b", "a", "yes"), ("3", "a", "c", "yes")], "id string, reviewer string, adjudicator string, decision string")
    assert [(r.id, r.decision) for r in curate.adjudicated(queue, reviews).collect()] == [("1", "yes")]


def test_small_functions(spark):
    assert curate.fnv_bucket("a", 1) == curate.fnv_bucket("a", 1) and 0 <= curate.fnv_bucket("C:가", 3) < 256
    row = spark.range(1).select(curate.quantised(F.lit(2.5), F.lit(1.0)).alias("even"), curate.quantised(F.lit(2.5), F.lit(1.0), False).alias("away"), curate.quantised(F.lit(500.0), F.lit(1.0)).alias("top")).first()
    assert tuple(row) == (2, 3, 127)
    sources = spark.createDataFrame([("a", "MIT", "http://x", "0" * 64, 1), ("b", "MIT", "https://x", "0" * 64, 1)], "name string, license string, url string, sha256 string, bytes long")
    assert [(r.name, r.problem) for r in curate.source_problems(sources, ["MIT"]).collect()] == [("a", "address")]
    assert spark.createDataFrame([("ＡＢ",)], "t string").select(curate.normal_form("t")).first()[0] == "AB"
