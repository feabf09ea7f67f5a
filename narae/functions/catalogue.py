"""The rule catalogue: metadata of every rule, literal patterns, rule packs, dictionaries and configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narae.functions.rule_tables import CONDITIONAL, FORMS, LITERALS

#: Profiles, each with all rules of those before.
PROFILES = {"default": 0, "strict": 1, "editorial": 2}
SEVERITIES = {"error": 2, "warning": 1, "info": 0}
#: Families whose literal rules hold anywhere in a word; others hold at its begin.
ANYWHERE = ("spelling.conjugation.", "grammar.ending.", "spacing.", "punctuation.")
BOUNDARIES = ("substring", "word", "prefix", "suffix")


@dataclass(frozen=True)
class Config:
    """What a run lints: a profile, rules left out, words never reported by the lexical rules."""

    profile: str = "default"
    disabled: frozenset[str] = frozenset()
    dictionary: frozenset[str] = frozenset()
    overlay: dict[str, str] = field(default_factory=dict)

    @property
    def level(self) -> int:
        return PROFILES[self.profile]

    @property
    def known_words(self) -> frozenset[str]:
        return self.dictionary | frozenset(self.overlay)


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    profile: str
    safety: str
    confidence: str
    incorrect: tuple[str, ...]
    correct: tuple[str, ...]

    @property
    def category(self) -> str:
        return self.id.split(".", 1)[0]

    @property
    def title(self) -> str:
        return self.id.split(".", 1)[1].replace(".", ": ").replace("-", " ")

    @property
    def message(self) -> str:
        return f"Write {self.correct[0]!r} rather than {self.incorrect[0]!r} ({self.title})."


def catalogue() -> list[Rule]:
    """All rules, by id. Literal rules come first where tables share an id."""
    found: dict[str, Rule] = {}
    for name, severity, profile, safety, pairs in LITERALS:
        wrong, right = zip(*pairs)
        found[name] = Rule(name, severity, profile, safety, "high" if safety == "safe" else "medium", wrong, right)
    for name, severity, wrong, right in FORMS:
        old = found.get(name)
        found[name] = Rule(name, severity, "default", "safe", "high", (*(old.incorrect if old else ()), wrong), (*(old.correct if old else ()), right))
    for name, profile, safety, confidence, wrong, right in CONDITIONAL:
        severity = "info" if name in ("repetition.adjacent-word", "grammar.ending.colloquial-yong") else "warning"
        found[name] = Rule(name, severity, profile, safety, confidence, (wrong,), (right,))
    return [found[k] for k in sorted(found)]


RULES = {r.id: r for r in catalogue()}


def boundary_of(rule_id: str) -> str:
    """The boundary of a bundled rule's patterns, by its family."""
    return "substring" if rule_id.startswith(ANYWHERE) else "prefix"


def rule_table(spark: SparkSession) -> DataFrame:
    """One row a rule. ``default_enabled`` is information only: profiles and disabled rules decide."""
    rows = [(r.id, r.title, r.message, r.category, r.severity, r.profile, r.safety, r.confidence, PROFILES[r.profile], r.profile == "default", list(r.incorrect), list(r.correct)) for r in catalogue()]
    schema = "rule_id string, title string, message string, category string, severity string, profile string, safety string, confidence string, level int, default_enabled boolean, incorrect array<string>, correct array<string>"
    return spark.createDataFrame(rows, schema)


def literal_table(spark: SparkSession) -> DataFrame:
    """Patterns that begin with Hangul, keyed by their first character (doubled commas have a rule of their own)."""
    rows = []
    for name, severity, profile, safety, pairs in LITERALS:
        rows += [(name, severity, PROFILES[profile], safety == "safe", a, b, boundary_of(name), 0, a[0]) for a, b in pairs if "가" <= a[0] <= "힣"]
    for name, severity, a, b in FORMS:
        if "가" <= a[0] <= "힣" and name != "grammar.particle.duplicate":
            rows.append((name, severity, 0, True, a, b, "substring", 2, a[0]))
    return spark.createDataFrame(rows, "rule_id string, severity string, level int, safe boolean, wrong string, right string, boundary string, turn int, first string")


def enabled(rules: DataFrame, config: Config) -> DataFrame:
    """Rules of the profile that are not disabled; filtered before any join."""
    kept = rules.where(F.col("level") <= config.level)
    return kept.where(~F.col("rule_id").isin(sorted(config.disabled))) if config.disabled else kept


def is_dictionary_rule(rule_id: Column) -> Column:
    return rule_id.startswith("spelling.lexical.") | (rule_id == "spelling.loanword.curated")


# --- rule packs, overlays, lexicons ----------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    wrong: str
    right: str
    boundary: str = "substring"


@dataclass(frozen=True)
class PackRule:
    id: str
    severity: str
    message: str
    patterns: tuple[Pattern, ...]
    profile: str = "default"
    confidence: str = "high"
    safe_fix: bool = False
    default_enabled: bool = True


def rule_pack(data: dict) -> list[PackRule]:
    """A validated rule pack (version 1, language ko) from parsed YAML or JSON. Raises ValueError."""
    if data.get("version") != 1 or data.get("language") != "ko":
        raise ValueError("a rule pack has version 1 and language ko")
    if not data.get("rules"):
        raise ValueError("a rule pack has at least one rule")
    rules, names, seen = [], set(RULES), set()
    for raw in data["rules"]:
        if raw["id"] in names:
            raise ValueError(f"rule id {raw['id']!r} is taken")
        names.add(raw["id"])
        if not raw.get("message", "").strip():
            raise ValueError(f"{raw['id']}: a message is needed")
        if raw["severity"] not in SEVERITIES or raw.get("profile", "default") not in PROFILES:
            raise ValueError(f"{raw['id']}: unknown severity or profile")
        patterns = []
        for p in raw.get("replacements", []):
            boundary = p.get("boundary", "substring")
            if not p.get("from") or not p.get("to") or boundary not in BOUNDARIES:
                raise ValueError(f"{raw['id']}: a replacement needs from, to and a known boundary")
            if p["from"] in seen:
                raise ValueError(f"{raw['id']}: {p['from']!r} has a rule already")
            seen.add(p["from"])
            patterns.append(Pattern(p["from"], p["to"], boundary))
        if not patterns:
            raise ValueError(f"{raw['id']}: a rule needs replacements")
        rules.append(PackRule(raw["id"], raw["severity"], raw["message"], tuple(patterns), raw.get("profile", "default"), raw.get("confidence", "high"), bool(raw.get("safe_fix")), raw.get("default_enabled", True)))
    return rules


def overlay(text: str, header: str = "narae-overlay-v1") -> dict[str, str]:
    """surface to part of speech. Blank lines are skipped; the last of repeated surfaces holds."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != header:
        raise ValueError(f"an overlay begins with {header}")
    out = {}
    for number, line in enumerate(lines[1:], 2):
        if line.strip():
            fields = line.split("\t")
            if len(fields) != 2 or not all(f.strip() for f in fields):
                raise ValueError(f"line {number}: surface and part of speech, with a tab between")
            out[fields[0].strip()] = fields[1].strip()
    return out


def lexicon(text: str, header: str = "narae-lexicon-v1") -> list[tuple[str, str, int]]:
    """(surface, part of speech, frequency), strictly ascending by surface."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != header:
        raise ValueError(f"a lexicon begins with {header}")
    out: list[tuple[str, str, int]] = []
    for number, line in enumerate(lines[1:], 2):
        fields = line.split("\t")
        if len(fields) != 3 or not re.fullmatch("[0-9]+", fields[2]):
            raise ValueError(f"line {number}: surface, part of speech and frequency")
        if out and out[-1][0] >= fields[0]:
            raise ValueError(f"line {number}: not in ascending order")
        out.append((fields[0], fields[1], int(fields[2])))
    return out


def merged_seeds(seeds: DataFrame) -> DataFrame:
    """Sums the frequencies of repeated surfaces of (surface, pos, frequency); see pos_conflicts()."""
    return seeds.groupBy("surface").agg(F.min("pos").alias("pos"), F.sum("frequency").alias("frequency"))


def pos_conflicts(seeds: DataFrame) -> DataFrame:
    """Surfaces with several parts of speech."""
    return seeds.groupBy("surface").agg(F.countDistinct("pos").alias("parts")).where("parts > 1")
