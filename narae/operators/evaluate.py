"""Evaluation: findings against expectations, metrics, gates and slices. Undefined ratios are null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narae.functions.catalogue import PROFILES, Config
from narae.operators.detect import lint
from narae.operators.fix import fix
from narae.session import materialise

#: Normal quantile of two-sided 95 per cent.
Z = 1.959963984540054


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def wilson(hits: Column, trials: Column, z: float = Z) -> Column:
    """Lower bound of the Wilson interval."""
    p = hits / trials
    lower = (p + z * z / (2 * trials) - z * F.sqrt((p * (1 - p) + z * z / (4 * trials)) / trials)) / (1 + z * z / trials)
    return F.when(trials > 0, F.greatest(F.lit(0.0), lower))


def matched(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, rule_id, tp, fp, fn) where expectations name rules only: multisets meet in the smaller count."""
    e = expected.groupBy("case_id", "rule_id").agg(F.count(F.lit(1)).alias("expected"))
    a = actual.groupBy("case_id", "rule_id").agg(F.count(F.lit(1)).alias("actual"))
    both = e.join(a, ["case_id", "rule_id"], "full").fillna(0, ["expected", "actual"])
    tp = F.least("expected", "actual")
    return both.select("case_id", "rule_id", tp.alias("tp"), (F.col("actual") - tp).alias("fp"), (F.col("expected") - tp).alias("fn"))


def resolved_ranges(expected: DataFrame, cases: DataFrame) -> DataFrame:
    """Expectations (case_id, rule_id, start, end, original, ...) with the range of an original that occurs
    once in its case's text (overlapping places count each), and the problem if there is one.

    Ranges are UTF-8 bytes.
    """
    rows = expected.join(cases.select("case_id", F.coalesce("text", F.lit("")).alias("_text")), "case_id", "left").withColumn("_bytes", F.encode("_text", "UTF-8"))
    ranged = F.col("start").isNotNull() & F.col("end").isNotNull()
    inside = lambda c: F.hex(F.expr(f"substring(_bytes, cast({c} + 1 as int), 1)")).rlike("^[89AB]")
    invalid = (F.col("start") < 0) | (F.col("start") > F.col("end")) | (F.col("end") > F.octet_length("_bytes")) | inside("start") | inside("`end`")
    part = F.expr("substring(_bytes, cast(start + 1 as int), cast(`end` - start as int))")
    first = F.expr("locate(original, _text, 1)")
    second = F.expr("locate(original, _text, locate(original, _text, 1) + 1)")
    problem = (
        F.when(F.col("_text").isNull(), "expectation without a case").when(ranged & invalid, "invalid range").when(F.col("original") == "", "empty original")
        .when(ranged & (part != F.encode("original", "UTF-8")), "range is not the original").when(~ranged & (first == 0), "absent original").when(~ranged & (second > 0), "repeated original")
    )
    begin = F.octet_length(F.expr("substring(_text, 1, locate(original, _text, 1) - 1)")).cast("long")
    found = rows.withColumn("problem", problem).withColumn("_new", ~ranged & F.col("original").isNotNull() & F.col("problem").isNull())
    found = found.withColumn("_begin", begin)
    start = F.when(F.col("_new"), F.col("_begin")).otherwise(F.col("start").cast("long"))
    end = F.when(F.col("_new"), F.col("_begin") + F.octet_length("original")).otherwise(F.col("end").cast("long"))
    return found.withColumns({"start": start, "end": end}).select(*expected.columns, "problem")


def matched_in_detail(expected: DataFrame, actual: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """As matched(), where expectations may name ranges, originals and suggestions too.

    With the cases' texts, an original that occurs once stands for its range; ranges are then UTF-8 bytes.
    Within a case, expectations with more conditions come first and each takes the first finding
    left that meets them. Cases are small; each is settled alone.
    """

    def settle(key, left, right):
        import pandas as pd

        rest = right.sort_values(["start", "end", "rule_id"]).to_dict("records")
        counts: dict[str, list[int]] = {}
        wanted = left.to_dict("records")
        known = lambda v: v is not None and v == v
        wanted.sort(key=lambda w: -sum((known(w["start"]), w["suggestions"] is not None, known(w["original"]))))
        for w in wanted:
            fits = (k for k, a in enumerate(rest) if a["rule_id"] == w["rule_id"] and (not known(w["start"]) or (a["start"], a["end"]) == (w["start"], w["end"])) and (not known(w["original"]) or a["original"] == w["original"]) and (w["suggestions"] is None or list(w["suggestions"]) == [a["suggestion"]]))
            k = next(fits, None)
            counts.setdefault(w["rule_id"], [0, 0, 0])[2 if k is None else 0] += 1
            if k is not None:
                rest.pop(k)
        for a in rest:
            counts.setdefault(a["rule_id"], [0, 0, 0])[1] += 1
        return pd.DataFrame([(key[0], rule, *c) for rule, c in counts.items()], columns=["case_id", "rule_id", "tp", "fp", "fn"])

    if cases is not None:
        expected = resolved_ranges(expected, cases).drop("problem")
    return expected.groupBy("case_id").cogroup(actual.groupBy("case_id")).applyInPandas(settle, "case_id string, rule_id string, tp long, fp long, fn long")


def per_rule(counts: DataFrame) -> DataFrame:
    sums = counts.groupBy("rule_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("rule_id", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), wilson(tp, tp + fp).alias("precision_low"), wilson(tp, tp + fn).alias("recall_low"))


def totals(counts: DataFrame) -> DataFrame:
    """Micro and macro precision and recall, with Wilson bounds, in one row."""
    rules = per_rule(counts)
    sums = rules.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), "macro_precision", "macro_recall", wilson(tp, tp + fp).alias("precision_low"), wilson(tp, tp + fn).alias("recall_low"))


def specificity(cases: DataFrame, actual: DataFrame) -> DataFrame:
    """(normal, clean, specificity): the share of normal cases without findings."""
    normal = cases.where("case_type = 'normal'")
    dirty = normal.join(actual.select("case_id").distinct(), "case_id", "left_semi")
    counts = normal.agg(F.count(F.lit(1)).alias("normal")).crossJoin(dirty.agg(F.count(F.lit(1)).alias("dirty")))  # one row each
    return counts.select("normal", (F.col("normal") - F.col("dirty")).alias("clean"), ratio(F.col("normal") - F.col("dirty"), F.col("normal")).alias("specificity"))


def case_failures(counts: DataFrame, fixed: DataFrame) -> DataFrame:
    """(case_id, reason): findings too many or too few, or another corrected text than expected.

    fixed: (case_id, fixed_text, expected_fixed_text).
    """
    wrong = counts.where("fp > 0 or fn > 0").select("case_id", F.lit("findings").alias("reason")).distinct()
    texts = fixed.where("expected_fixed_text is not null and not (fixed_text <=> expected_fixed_text)").select("case_id", F.lit("fixed text").alias("reason"))
    return wrong.unionByName(texts)


def dataset_metadata(cases: DataFrame) -> DataFrame:
    """What a corpus is made of, in one row; splits as counts."""
    when = lambda c: F.sum(F.when(c, 1).otherwise(0))
    origin = F.coalesce("origin", F.lit("project"))
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), when(origin != "synthetic").alias("natural"), when(origin == "synthetic").alias("synthetic"), when(origin == "revision").alias("human_edits"),
        when(origin == "independent_human").alias("independent"), when(F.col("case_type") == "normal").alias("normal"), F.countDistinct(F.trim("genre")).alias("genres"),
        F.countDistinct(F.trim("document_id")).alias("documents"), *[when(F.col("split") == s).alias(f"split_{s}") for s in ("train", "dev", "release_holdout")],
    )


@dataclass(frozen=True)
class Gate:
    """A threshold: a metric that must reach a value, if at least so many trials back it."""

    metric: str
    least: float
    trials: str | None = None
    least_trials: int = 0


def gate_failures(metrics: DataFrame, gates: list[Gate]) -> DataFrame:
    """(metric, value, least) of the gates that one row of metrics fails. A null value fails too."""
    rows = F.array(*[F.struct(F.lit(g.metric).alias("metric"), F.col(g.metric).cast("double").alias("value"), F.lit(float(g.least)).alias("least"), (F.col(g.trials) >= g.least_trials if g.trials else F.lit(True)).alias("counts")) for g in gates])
    return metrics.select(F.explode(rows).alias("g")).select("g.*").where("counts and (value is null or value < least)").drop("counts")


def quality_slices(cases: DataFrame) -> DataFrame:
    """(dimension, value, cases, errors, normals) by genre, origin, split and each error family: a case is in many."""
    one = lambda name: F.array(F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value")))
    families = F.transform(F.coalesce("error_families", F.array().cast("array<string>")), lambda f: F.struct(F.lit("error_family").alias("dimension"), f.alias("value")))
    rows = cases.withColumn("s", F.explode(F.concat(one("genre"), one("origin"), one("split"), families))).where("s.value is not null")
    count = lambda kind: F.sum(F.when(F.col("case_type") == kind, 1).otherwise(0))
    return rows.groupBy("s.dimension", "s.value").agg(F.count(F.lit(1)).alias("cases"), count("error").alias("errors"), count("normal").alias("normals"))


def corpus_problems(cases: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(case_id, problem) of a corpus: repeated or blank ids, contradicting types, missing provenance; with
    expectations as of resolved_ranges(), their problems too."""
    ident = F.trim("case_id")
    rows = cases.withColumn("copies", F.count(F.lit(1)).over(W.partitionBy(ident)))
    expects = F.coalesce(F.size("expected_rule_ids"), F.lit(0)) > 0
    origin = F.coalesce("origin", F.lit("project"))
    problems = F.array_compact(F.array(
        F.when((ident == "") | F.col("case_id").isNull(), "blank id"), F.when(F.col("copies") > 1, "repeated id"),
        F.when((F.col("case_type") == "normal") & expects, "normal case with expectations"), F.when((F.col("case_type") == "error") & ~expects, "error case without expectations"),
        F.when((origin != "project") & (F.col("genre").isNull() | F.col("document_id").isNull() | F.col("split").isNull()), "no provenance"),
    ))
    out = rows.select("case_id", F.explode(problems).alias("problem"))
    if expected is not None:
        out = out.unionByName(resolved_ranges(expected, cases).where("problem is not null").select("case_id", "problem"))
    return out


def corpus_findings(cases: DataFrame) -> DataFrame:
    """(case_id, rule_id, start, end (UTF-8 bytes), original, suggestion) of corpus cases (as read_corpus() reads
    them, with case_id), each linted by its own profile."""
    out = None
    rows = cases.select(F.xxhash64("case_id").alias("doc_id"), "case_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("sourceKind", F.lit("plain_text")).alias("source_kind"), F.coalesce("profile", F.lit("default")).alias("profile"))
    for profile in PROFILES:
        mine = rows.where(F.col("profile") == profile).drop("profile")
        found = lint(mine, Config(profile)).join(mine.select("doc_id", "case_id"), "doc_id")
        found = found.select("case_id", "rule_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), "original", "suggestion")
        out = found if out is None else out.unionByName(found)
    return out


def expectations(cases: DataFrame) -> DataFrame:
    """(case_id, rule_id, start, end, original, suggestions): detailed ones, and rules alone beyond those."""
    detailed = cases.select("case_id", F.explode("expectedDiagnostics").alias("d")).select(
        "case_id", F.col("d.ruleId").alias("rule_id"), F.col("d.range.start").cast("long").alias("start"), F.col("d.range.end").cast("long").alias("end"), F.col("d.original").alias("original"), F.col("d.suggestions").alias("suggestions")
    )
    named = F.coalesce("expectedRuleIds", F.array().cast("array<string>"))
    done = F.transform(F.coalesce("expectedDiagnostics", F.array()), lambda d: d["ruleId"])
    plain = cases.where(F.size(F.coalesce(F.col("expectedDiagnostics"), F.array())) == 0).select("case_id", F.explode(named).alias("rule_id"))
    none = F.lit(None)
    rest = cases.where(F.size(F.coalesce(F.col("expectedDiagnostics"), F.array())) > 0).select("case_id", F.explode(F.array_except(named, done)).alias("rule_id"))
    bare = plain.unionByName(rest).select("case_id", "rule_id", none.cast("long").alias("start"), none.cast("long").alias("end"), none.cast("string").alias("original"), none.cast("array<string>").alias("suggestions"))
    return detailed.unionByName(bare)


def corpus_report(corpus: DataFrame, gates: dict | None = None) -> tuple[dict, bool]:
    """A corpus run end to end: what it is made of, its problems, metrics, failing cases and gates.

    gates: least values by metric. Passed is a run without problems of the corpus and without failing gates;
    the report has counts and one row a metric, not the cases themselves.
    """
    names = {"id": "case_id", "caseType": "case_type", "documentId": "document_id", "errorFamilies": "error_families", "expectedRuleIds": "expected_rule_ids"}
    cases = materialise(corpus.withColumn("case_id", F.trim("id")), "corpus")
    shown = cases.withColumnsRenamed({k: v for k, v in names.items() if k != "id"})
    detailed = F.transform(F.coalesce("expectedDiagnostics", F.array()), lambda d: d["ruleId"])
    shown = shown.withColumn("expected_rule_ids", F.concat(F.coalesce("expected_rule_ids", F.array().cast("array<string>")), detailed))
    wanted = expectations(cases)
    actual = materialise(corpus_findings(cases), "corpus-findings")
    counts = materialise(matched_in_detail(wanted, actual, cases), "corpus-counts")
    docs = cases.where("expectedFixedText is not null").select(F.xxhash64("case_id").alias("doc_id"), "case_id", "text", F.coalesce("sourceKind", F.lit("plain_text")).alias("source_kind"), F.col("expectedFixedText").alias("expected_fixed_text"))
    failures = case_failures(counts, fix(docs).withColumnRenamed("fixed", "fixed_text"))
    total, clean = totals(counts).first().asDict(), specificity(shown, actual).first().asDict()
    problems = {r.problem: r["count"] for r in corpus_problems(shown, wanted).groupBy("problem").count().collect()}
    metrics = total | {"specificity": clean["specificity"]}
    failed = [(k, metrics.get(k), least) for k, least in (gates or {}).items() if metrics.get(k) is None or metrics[k] < least]
    report = {"dataset": dataset_metadata(shown).first().asDict(), "problems": problems, "metrics": metrics, "failures": {r.reason: r["count"] for r in failures.groupBy("reason").count().collect()}, "failedGates": failed}
    return report, not problems and not failed


#: Parts that a range of values is cut into at once.
BUCKETS = 1000


def quantile_values(samples: DataFrame, column: str, shares: list[float], tolerance: int = 10_000) -> list[float | None]:
    """Exact quantiles (linear between neighbours) of a numeric column, in the order of ``shares``.

    The range of values is cut into buckets that are counted in one pass; the buckets that hold the wanted ranks
    are cut again, until so few rows are left that these alone are gathered. No task holds all values.
    """
    rows = samples.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    wanted = sorted({int(k) for s in shares for k in (s * (n - 1), min(s * (n - 1) + 1, n - 1))})
    found: dict[int, float] = {}
    open_ = [(low, high, 0, n, wanted)]  # values from low to high, both included; rows before; rows; ranks
    while open_:
        low, high, before, size, ranks = open_.pop()
        inside = rows.where(F.col("x").between(low, high))
        if low == high or size <= tolerance:
            values = [low] * size if low == high else sorted(r.x for r in inside.collect())  # ``tolerance`` rows at most
            found |= {k: values[k - before] for k in ranks}
            continue
        bucket = F.least(F.floor((F.col("x") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        parts = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()  # BUCKETS rows
        for part in sorted(parts, key=lambda p: p.b):
            if own := [k for k in ranks if before <= k < before + part.n]:
                open_.append((part.low, part.high, before, part.n, own))
            before += part.n
    out = []
    for s in shares:
        at = s * (n - 1)
        a, b = found[int(at)], found[int(min(at + 1, n - 1))]
        out.append(a + (b - a) * (at - int(at)))
    return out


def latency(samples: DataFrame, size: float) -> DataFrame:
    """Least, mean, median and 95th percentile of ``ms`` and the rate at the median, for texts of ``size`` bytes."""
    p50, p95 = quantile_values(samples, "ms", [0.5, 0.95])
    out = samples.agg(F.min("ms").alias("least"), F.avg("ms").alias("mean"))
    out = out.withColumn("p50", F.lit(p50).cast("double")).withColumn("p95", F.lit(p95).cast("double"))
    return out.withColumn("mib_per_s", F.lit(size / 2**20) / (F.col("p50") / 1000))


def set_difference(expected: Column, actual: Column) -> Column:
    """(missing, unexpected) members; both empty where sets are equal."""
    return F.struct(F.array_except(expected, actual).alias("missing"), F.array_except(actual, expected).alias("unexpected"))
