"""Single documents and their JSON form: what editors and services ask for."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from narae.functions.catalogue import RULES, Config
from narae.operators.candidates import merged, rank_score, spacing_candidates, spelling_candidates, with_evidence
from narae.operators.detect import lint
from narae.operators.fix import fix
from narae.operators.standard import ContextRanker, Scorer, standard
from narae.sources.tokens import tokens


def config_of(data: dict) -> Config:
    """A configuration from its JSON form; unknown keys are ignored, lists sorted and made distinct by nature."""
    overlay = {e["surface"]: e.get("pos", "") for e in data.get("dictionaryOverlay", [])}
    return Config(data.get("profile", "default"), frozenset(data.get("disabledRules", [])), frozenset(data.get("userDictionary", [])), overlay)


def lint_json(spark: SparkSession, request: str) -> str:
    """Findings of {text, sourceKind, config, includeReview}, with corrected texts; reviews are included by default."""
    data = json.loads(request)
    docs = spark.createDataFrame([(0, data["text"], data.get("sourceKind", "plain_text"))], "doc_id long, text string, source_kind string")
    config = config_of(data.get("config", {}))
    rows = with_evidence(lint(docs, config)).orderBy("start", "end", "rule_id", "turn").drop("doc_id", "turn").toJSON().collect()
    out = {"diagnostics": [json.loads(r) for r in rows], "fixedText": fix(docs, config).first().fixed}
    if data.get("includeReview", True):
        out["reviewFixedText"] = fix(docs, config, review=True).first().fixed
    return json.dumps(out, ensure_ascii=False)


def lint_standard_json(spark: SparkSession, request: str, lexicon, scorer: Scorer | None = None) -> str:
    """The same by the standard pipeline: findings and dictionary candidates with evidence, corrected texts."""
    data = json.loads(request)
    docs = spark.createDataFrame([(0, data["text"], data.get("sourceKind", "plain_text"))], "doc_id long, text string, source_kind string")
    out = standard(docs, lexicon, config_of(data.get("config", {})), scorer, data.get("includeReview", True))
    row = json.loads(out.select(F.to_json(F.struct("diagnostics", "fixed_text", "review_fixed_text"))).first()[0])
    found = [{k: v for k, v in d.items() if k != "turn"} for d in row.get("diagnostics", [])]
    return json.dumps({"version": 1, "diagnostics": found, "fixedText": row["fixed_text"], "reviewFixedText": row["review_fixed_text"]}, ensure_ascii=False)


def lint_context_json(spark: SparkSession, request: str, lexicon, manifest: str) -> str:
    """The same, candidates ranked by a context model given in its JSON form."""
    return lint_standard_json(spark, request, lexicon, ContextRanker.load(manifest))


def lint_with_lexicon(spark: SparkSession, docs, lexicon, config: Config = Config()):
    """Findings, and candidates for words out of a lexicon as review findings beside them."""
    found = lint(docs, config)
    words = tokens(docs).where("kind = 'word'")
    rows = spelling_candidates(words, lexicon).unionByName(spacing_candidates(words, lexicon))
    ranked = rows.withColumn("score", rank_score(F.col("edits"), F.col("freq"), F.col("score")))
    return found, merged(ranked, found, config)


def rule_catalogue_json() -> str:
    rows = [{"id": r.id, "title": r.title, "description": r.message, "category": r.category, "confidence": r.confidence, "fixSafety": r.safety, "profile": r.profile, "incorrectExamples": r.incorrect, "correctExamples": r.correct} for r in RULES.values()]
    return json.dumps({"version": 1, "ruleCount": len(rows), "rules": rows}, ensure_ascii=False)


def rule_catalogue_markdown() -> str:
    """The catalogue as a document, a section a rule."""
    out = [f"# {len(RULES)} rules", ""]
    for r in RULES.values():
        out += [f'<a id="{r.id}"></a>', f"## `{r.id}`: {r.title}", "", r.message, "", f"- category: `{r.category}`", f"- confidence: `{r.confidence}`", f"- correction: `{r.safety}`", f"- profile: `{r.profile}`"]
        out += [f"- example: `{a}` → `{b}`" for a, b in list(zip(r.incorrect, r.correct))[:1]] + [""]
    return "\n".join(out)


def explain(rule_id: str) -> str:
    """A rule in a few lines. An unknown id raises KeyError."""
    r = RULES[rule_id]
    examples = "\n".join(f"  {a} → {b}" for a, b in zip(r.incorrect, r.correct))
    return f"{r.id} ({r.severity}, {r.profile}, fix: {r.safety}, confidence: {r.confidence})\n{r.message}\n{examples}"
