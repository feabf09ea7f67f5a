"""The standard pipeline: rule findings and dictionary candidates together, ranked, with corrected texts.

Generators, scorers and traces are plain protocols, so that others can take the place of the bundled ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narae.functions.catalogue import Config
from narae.operators.candidates import F_SUGGESTIONS, PER_SPAN, confidence, rank_score, spacing_candidates, spelling_candidates, with_evidence
from narae.operators.curate import fnv_bucket
from narae.operators.detect import lint
from narae.operators.fix import accepted, applied, fix
from narae.sources.tokens import tokens

#: What a candidate needs: a row each, at its place.
CANDIDATE = ["doc_id", "start", "end", "original", "replacement", "edits", "freq", "score", "rule_id"]


class Generator(Protocol):
    """Candidates (with the columns of CANDIDATE) for words (the token table), given a lexicon."""

    def __call__(self, words: DataFrame, lexicon: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    """The score of candidate rows (CANDIDATE and ``text``), and the probability that it stands for."""

    def score(self) -> Column: ...

    def probability(self, score: Column) -> Column: ...


@dataclass(frozen=True)
class LinearScorer:
    """The shipped ranker; its scores are probabilities."""

    def score(self) -> Column:
        return rank_score(F.col("edits"), F.col("freq"), F.col("score"))

    def probability(self, score: Column) -> Column:
        return score


HASHED, NUMERIC = 256, 4


@dataclass(frozen=True)
class ContextRanker:
    """A loadable linear ranker over hashed n-grams of the text before and after, and four numbers."""

    weights: tuple[int, ...]
    feature_scale: float
    weight_scale: float
    bias: float = 0.0

    @classmethod
    def load(cls, manifest: str) -> ContextRanker:
        """From its JSON form. Another version, size or scale raises ValueError."""
        data = json.loads(manifest)
        scales = [data["feature_scale"], data["weight_scale"]]
        if data["schema_version"] != 1 or data["feature_dim"] != HASHED + NUMERIC or len(data["weights"]) != HASHED + NUMERIC or not all(0 < s < float("inf") for s in scales):
            raise ValueError("not a context ranker of this form")
        return cls(tuple(data["weights"]), *scales, float(data.get("bias", 0.0)))

    def features(self, before: str, after: str) -> np.ndarray:
        hashed = np.zeros(HASHED, np.float32)
        for marker, text in (("S", before), ("C", after)):
            plain = " ".join(text.split())
            for size in (1, 2, 3):
                grams = pd.Series([plain[k : k + size] for k in range(len(plain) - size + 1)], dtype=object).value_counts()
                for gram, n in grams.items():
                    hashed[fnv_bucket(f"{marker}:{gram}", size)] += n
        hashed /= max(hashed.sum(), np.float32(1))
        common = next((k for k, (a, b) in enumerate(zip(before, after)) if a != b), min(len(before), len(after)))
        length = max(len(before), len(after), 1)
        return np.concatenate([hashed, np.array([1.0, 1.0 - common / length, np.log(len(after) + 1.0), len(after) - len(before)], np.float32)])

    def of_texts(self, before: str, after: str) -> float:
        x = self.features(before, after) / np.float32(self.feature_scale)
        whole = np.clip(np.sign(x) * np.floor(np.abs(x) + np.float32(0.5)), -127, 127).astype(int)
        return float(np.dot(whole, self.weights) * self.feature_scale * self.weight_scale + self.bias)

    def score(self) -> Column:
        ranker = self

        @F.pandas_udf("double")
        def scored(text: pd.Series, start: pd.Series, end: pd.Series, replacement: pd.Series) -> pd.Series:
            return pd.Series([ranker.of_texts(t, t[:a] + r + t[b:]) for t, a, b, r in zip(text, start, end, replacement)], dtype=float)

        return scored("text", "start", "end", "replacement")

    def probability(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-score))


@dataclass
class Trace:
    """Counts of what each stage passes on, without any text: filled in once the findings are used."""

    seen: dict[str, Observation] = field(default_factory=dict)

    def record(self, rows: DataFrame, stage: str) -> DataFrame:
        self.seen[stage] = Observation(stage)
        return rows.observe(self.seen[stage], F.count(F.lit(1)).alias("rows"), F.count_if(F.col("rule_id").startswith("spacing.")).alias("spacing"))

    def events(self) -> Iterator[tuple[str, dict]]:
        for stage, observation in self.seen.items():
            yield stage, observation.get


def _taken(findings: DataFrame) -> DataFrame:
    return findings.where("suggestion is not null").select("doc_id", "start", "end", F.col("suggestion").alias("replacement")).distinct()


def candidate_findings(rows: DataFrame, findings: DataFrame, config: Config, probability) -> DataFrame:
    """Scored candidates as review findings: without disabled rules, changes of nothing and what a finding
    suggests already; of a span the eight best together, of which the best gives confidence and evidence."""
    rows = rows.where("original != replacement")
    if config.disabled:
        rows = rows.where(~F.col("rule_id").isin(sorted(config.disabled)))
    rows = rows.join(_taken(findings), ["doc_id", "start", "end", "replacement"], "left_anti")
    best = W.partitionBy("doc_id", "start", "end", "replacement").orderBy(F.desc("score"), "rule_id")
    rows = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    place = W.partitionBy("doc_id", "start", "end", "rule_id", "original").orderBy(F.desc("score"), "replacement")
    rows = rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= PER_SPAN)
    evidence = F.array(
        F.struct(F.lit("edit-distance").alias("code"), F.col("edits").cast("string").alias("value"), F.col("score").alias("score")),
        F.struct(F.lit("frequency").alias("code"), F.col("freq").cast("string").alias("value"), F.col("score").alias("score")),
    )
    one = F.struct(F.col("replacement").alias("text"), F.lit("review").alias("safety"), confidence(probability(F.col("score"))).alias("confidence"), evidence.alias("evidence"))
    grouped = rows.select("doc_id", "start", "end", "rule_id", "original", "_n", one.alias("one")).groupBy("doc_id", "start", "end", "rule_id", "original")
    found = grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "one"))), lambda s: s["one"]).cast(F_SUGGESTIONS).alias("suggestions"))
    return found.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "rule_id", F.lit("info").alias("severity"), "original", F.lit("review").alias("safety"),
        F.get("suggestions", F.lit(0))["confidence"].alias("confidence"), F.get("suggestions", F.lit(0))["evidence"].alias("evidence"), "suggestions", F.lit(30).alias("turn"),
    )


def standard_findings(docs: DataFrame, lexicon: DataFrame, config: Config = Config(), scorer: Scorer | None = None, generators: tuple[Generator, ...] = (spelling_candidates, spacing_candidates), trace: Trace | None = None) -> DataFrame:
    """Findings of the rules and of the candidates, with nested suggestions. Order by start, end, rule_id, turn."""
    scorer = scorer or LinearScorer()
    noted = trace.record if trace else lambda rows, stage: rows
    rules = noted(lint(docs, config), "rules")
    words = tokens(docs).where("kind = 'word'")
    rows = None
    for generate in generators:
        own = generate(words, lexicon).select(*CANDIDATE)
        rows = own if rows is None else rows.unionByName(own)
    if isinstance(scorer, ContextRanker):  # only these need the texts
        rows = rows.join(docs.select("doc_id", "text"), "doc_id")
    scored = noted(rows.withColumn("score", scorer.score()), "candidates")
    more = candidate_findings(scored, rules, config, scorer.probability)
    shown = with_evidence(rules).select(*more.columns)
    return noted(shown.unionByName(more), "findings")


def review_edits(findings: DataFrame) -> DataFrame:
    """(doc_id, edits): the first suggestion of each finding that may be applied, none overlapping another."""
    rows = findings.where("safety != 'none'").withColumn("suggestion", F.get("suggestions", F.lit(0))["text"]).where("suggestion is not null")
    return accepted(rows.withColumn("turn", F.lit(0)), review=True, ties="suggestion")


def standard(docs: DataFrame, lexicon: DataFrame, config: Config = Config(), scorer: Scorer | None = None, include_review: bool = True) -> DataFrame:
    """``docs`` with diagnostics (in order), ``fixed_text`` (safe corrections to a fixpoint) and
    ``review_fixed_text`` (all first suggestions, once; without reviews the same as fixed_text)."""
    found = standard_findings(docs, lexicon, config, scorer)
    one = F.struct("start", "end", "rule_id", "turn", "severity", "original", "safety", "confidence", "suggestions", "evidence")
    lists = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("diagnostics"))
    out = fix(docs, config).withColumnRenamed("fixed", "fixed_text").join(lists, "doc_id", "left")
    if not include_review:
        return out.withColumn("review_fixed_text", F.col("fixed_text"))
    return applied(out, review_edits(found)).withColumnRenamed("fixed", "review_fixed_text")


def tokens_in_ranges(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """The (doc_id, start, end, ...) tokens that lie wholly within a range of their document."""
    lists = ranges.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).alias("_ranges"))
    inside = F.exists("_ranges", lambda r: (F.col("start") >= r["a"]) & (F.col("end") <= r["b"]))
    return found.join(lists, "doc_id").where(inside).drop("_ranges")


def with_parts_of_speech(words: DataFrame, analysed: DataFrame) -> DataFrame:
    """``words`` (doc_id, start, surface) with ``pos``: that of the analysed token (doc_id, start, end, pos)
    with just their range, the least of several; null where there is none."""
    own = analysed.groupBy("doc_id", "start", F.col("end").alias("_end")).agg(F.min("pos").alias("pos"))
    return words.withColumn("_end", F.col("start") + F.char_length("surface")).join(own, ["doc_id", "start", "_end"], "left").drop("_end")
