"""Dictionary candidates for words out of the lexicon, their ranking, and what may be done with them.

A lexicon is a table (surface, pos, freq). Distinct words meet it once and come back to their places
afterwards: there are far fewer of them than tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narae.operators import neighbours

# Candidates of a word, a document and a span, and edits.
PER_WORD, PER_DOCUMENT, PER_SPAN = 32, 32, 8
SPELLING, SPACING = "spelling.lexical.candidate", "spacing.lexical.candidate"
# Fixed values of the shipped ranking models: weights (int8) and their scales.
RANK_SCALE = 0.031496062992125984
RANK_WEIGHTS = {"bias": 127, "edit_distance": -29, "phonology_distance": -14, "log_frequency": 6, "base_score": 11}
CONTEXT_FEATURE_SCALE, CONTEXT_WEIGHT_SCALE = 0.6141732283464567, 0.12488756642465952
CONTEXT_WEIGHTS = (0, 127, 1, 2)
# Scores that corrections and grades of confidence need.
SAFE_SCORE, REVIEW_SCORE = 0.99, 0.60
HIGH, MEDIUM = 0.85, 0.6


def unknown_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The distinct words that the lexicon lacks."""
    return words.select(F.col("surface").alias("word")).distinct().join(lexicon.select(F.col("surface").alias("word")), "word", "left_anti")


def near_words(words: DataFrame, lexicon: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(word, replacement, edits, sounds, freq, score): the best entries within two edits of unknown words.

    Entries at most one longer or shorter; words of two characters at least. ``index``: a stored deletion_index of
    the lexicon, else one is built. The result is that of all pairs; see neighbours.py for the way.
    """
    unknown = unknown_words(words, lexicon).where(F.char_length("word") >= 2)
    near = neighbours.nearest(unknown, neighbours.deletion_index(lexicon) if index is None else index, PER_WORD)
    return near.select("word", "replacement", "edits", "sounds", "freq", "score")


def _per_document(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where(F.col("place") <= PER_DOCUMENT).drop("place")


def spelling_candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The best candidates of each document, at their places."""
    near = near_words(words, lexicon)
    rows = words.join(near, words["surface"] == near["word"]).select("doc_id", "start", (F.col("start") + F.char_length("surface")).alias("end"), F.col("surface").alias("original"), "replacement", "edits", "freq", "score", F.lit(SPELLING).alias("rule_id"))
    return _per_document(rows, F.desc("score"), "start", "end", "replacement")


def split_candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Unknown words that are two known ones."""
    unknown = unknown_words(words, lexicon).where(F.char_length("word") >= 2)
    cuts = unknown.withColumn("cut", F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)))
    cuts = cuts.select("word", F.substring(F.col("word"), F.lit(1), F.col("cut")).alias("left"), F.expr("substring(word, cut + 1)").alias("right"))
    entry = lambda side: lexicon.select(F.col("surface").alias(side), F.col("freq").alias(f"{side}_freq"))
    both = cuts.join(entry("left"), "left").join(entry("right"), "right")
    score = F.least(F.log(F.col("left_freq") + F.col("right_freq") + 2) / 32, F.lit(1.0))
    both = both.select("word", F.concat_ws(" ", "left", "right").alias("replacement"), (F.col("left_freq") + F.col("right_freq")).alias("freq"), score.alias("score"))
    return words.join(both, words["surface"] == both["word"]).select("doc_id", "start", (F.col("start") + F.char_length("surface")).alias("end"), F.col("surface").alias("original"), "replacement", F.lit(0).alias("edits"), "freq", "score", F.lit(SPACING).alias("rule_id"))


def join_candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Neighbouring words with white space between that are one known word together."""
    pairs = words.where("next != ''").select("doc_id", "start", F.concat("surface", "gap", "next").alias("original"), F.concat("surface", "next").alias("replacement"))
    joined = pairs.join(lexicon.select(F.col("surface").alias("replacement"), "freq"), "replacement")
    score = F.least(F.log(F.col("freq") + 1) / 16, F.lit(1.0))
    return joined.select("doc_id", "start", (F.col("start") + F.char_length("original")).alias("end"), "original", "replacement", F.lit(0).alias("edits"), "freq", score.alias("score"), F.lit(SPACING).alias("rule_id"))


def spacing_candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    return _per_document(split_candidates(words, lexicon).unionByName(join_candidates(words, lexicon)), F.desc("score"), "start", "replacement")


def rank_score(edits: Column, frequency: Column, base: Column, sounds: Column | None = None) -> Column:
    """Calibrated score of the linear ranker."""
    w = {k: v * RANK_SCALE for k, v in RANK_WEIGHTS.items()}
    linear = w["bias"] + w["edit_distance"] * edits + w["log_frequency"] * F.log(frequency + 1) + w["base_score"] * base
    if sounds is not None:
        linear = linear + w["phonology_distance"] * sounds
    return 1 / (1 + F.exp(-linear))


def context_score(text: Column, start: Column, original: Column, replacement: Column) -> Column:
    """Score of the context ranker for a text with one replacement.

    Of its features only the last four have weights other than 0: they need lengths and the common
    begin, so the text is not rewritten. Numbers round half away from zero.
    """
    n = F.char_length(text)
    m = n - F.char_length(original) + F.char_length(replacement)
    after = lambda new: F.concat(new, F.substring(text, (start + F.char_length(original) + 1).cast("int"), F.char_length(replacement)))
    a, b = F.split(after(original), ""), F.split(F.substring(after(replacement), F.lit(1), F.char_length(replacement) + F.char_length(original)), "")
    limit = F.least(F.size(a), F.size(b))
    common = F.aggregate(F.sequence(F.lit(1), limit), F.lit(0), lambda s, k: F.when((s == k - 1) & (F.get(a, k - 1) == F.get(b, k - 1)), k).otherwise(s))
    ratio = 1 - (start + common) / F.greatest(n, m, F.lit(1))
    quantised = lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), F.round(x / CONTEXT_FEATURE_SCALE).cast("int")))
    _, w1, w2, w3 = CONTEXT_WEIGHTS
    return CONTEXT_FEATURE_SCALE * CONTEXT_WEIGHT_SCALE * (w1 * quantised(ratio) + w2 * quantised(F.log(m + F.lit(1.0))) + w3 * quantised((m - n).cast("double")))


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def merged(candidates: DataFrame, findings: DataFrame, config=None) -> DataFrame:
    """Candidates as review findings: without disabled rules, changes of nothing and what a finding
    suggests already; the eight best of a span together, in order of their scores."""
    rows = candidates.where("original != replacement")
    if config and config.disabled:
        rows = rows.where(~F.col("rule_id").isin(sorted(config.disabled)))
    taken = findings.select("doc_id", "start", "end", F.col("suggestion").alias("replacement")).distinct()
    rows = rows.join(taken, ["doc_id", "start", "end", "replacement"], "left_anti").dropDuplicates(["doc_id", "start", "end", "replacement"])
    place = W.partitionBy("doc_id", "start", "end", "rule_id", "original").orderBy(F.desc("score"), "replacement")
    best = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= PER_SPAN)
    return best.groupBy("doc_id", "start", "end", "rule_id", "original").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "replacement"))), lambda s: s["replacement"]).alias("suggestions"), F.max("score").alias("score")
    )


def policy(family: Column, safe: Column, confident: Column, score: Column, style: Column) -> Column:
    """What may be done with a candidate: safe, review or abstain."""
    risky = family.rlike("^(proper|name|style|register)") | style.isin("formal", "technical", "code")
    return F.when(~safe, "abstain").when(risky, "review").when((confident == "high") & (score >= SAFE_SCORE), "safe").otherwise("review")


# What a style is told by, the first that holds.
STYLES = [
    ("code", ["fn ", "function ", "import ", "const ", "=>", "println!(", "{}"]),
    ("formal", ["본 문서", "규정", "보고서", "공문", "의거하여"]),
    ("technical", ["API", "JSON", "Rust", "함수", "코드"]),
]


def style(text: Column) -> Column:
    """(profile, sentence_count, average_sentence_length) of a text."""
    profile = F.lit("plain")
    for name, needles in reversed(STYLES):
        holds = F.lit(False)
        for needle in needles:
            holds = holds | F.contains(text, F.lit(needle))
        profile = F.when(holds, name).otherwise(profile)
    count = F.greatest(F.char_length(text) - F.char_length(F.translate(text, ".?!。？！", "")), F.lit(1))
    return F.struct(profile.alias("profile"), count.alias("sentence_count"), (F.char_length(text) / count).alias("average_sentence_length"))


def exact_candidates(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates for words that a rule (rule_id, wrong, right) lists, with score 1; the best of a document."""
    joined = words.join(F.broadcast(rules), words["surface"] == rules["wrong"])  # a rule table is small
    rows = joined.select("doc_id", "start", (F.col("start") + F.char_length("surface")).alias("end"), F.col("surface").alias("original"), F.col("right").alias("replacement"), F.lit(0).alias("edits"), F.lit(0).cast("long").alias("freq"), F.lit(1.0).alias("score"), "rule_id")
    return _per_document(rows, "start", "replacement")


def plain_score(original: Column, replacement: Column) -> Column:
    """Score without a ranker: nothing for no change, a quarter for a deletion, else a half."""
    return F.when(original == replacement, 0.0).when(replacement == "", 0.25).otherwise(0.5)


def correction_plan(candidates: DataFrame) -> DataFrame:
    """(doc_id, edits): candidates by start, end and rule, none overlapping the last one taken."""
    from narae.operators.fix import accepted

    rows = candidates.withColumn("turn", F.lit(0)).withColumnRenamed("replacement", "suggestion")
    return accepted(rows, review=True)


def with_evidence(findings: DataFrame) -> DataFrame:
    """Findings with nested suggestions: safe ones of high confidence and score 1, reviews of medium
    and 0.5, and without a suggestion low and 0.5."""
    some = F.col("suggestion").isNotNull()
    safety = F.when(~some, "none").when(F.col("safe"), "safe").otherwise("review")
    sure = F.when(safety == "safe", "high").when(safety == "review", "medium").otherwise("low")
    score = F.when(safety == "safe", 1.0).otherwise(0.5)
    evidence = F.array(F.struct(F.lit("rule").alias("code"), F.col("rule_id").alias("value"), score.alias("score")))
    suggestion = F.struct(F.col("suggestion").alias("text"), safety.alias("safety"), sure.alias("confidence"), evidence.alias("evidence"))
    return findings.withColumn("safety", safety).withColumn("confidence", sure).withColumn("evidence", evidence).withColumn("suggestions", F.when(some, F.array(suggestion)).otherwise(F.array().cast(F_SUGGESTIONS)))


F_SUGGESTIONS = "array<struct<text:string,safety:string,confidence:string,evidence:array<struct<code:string,value:string,score:double>>>>"


def without_evidence(findings: DataFrame) -> DataFrame:
    """Nested suggestions as plain texts again."""
    return findings.withColumn("suggestions", F.transform("suggestions", lambda s: s["text"])).drop("safety", "confidence", "evidence")
