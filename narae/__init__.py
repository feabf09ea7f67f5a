"""Text analytics on Spark: linting of Korean prose, and operators of a training-data pipeline."""

from narae.api import explain, lint_context_json, lint_json, lint_standard_json, rule_catalogue_json, rule_catalogue_markdown
from narae.functions.catalogue import RULES, Config, lexicon, overlay, rule_pack
from narae.operators.detect import lint
from narae.operators.fix import fix, lint_with_fixes
from narae.operators.standard import ContextRanker, LinearScorer, Trace, standard, standard_findings
from narae.sources.files import read_corpus, scan

__all__ = [
    "RULES", "Config", "ContextRanker", "LinearScorer", "Trace", "explain", "fix", "lexicon", "lint", "lint_context_json", "lint_json", "lint_standard_json", "lint_with_fixes", "overlay", "read_corpus",
    "rule_catalogue_json", "rule_catalogue_markdown", "rule_pack", "scan", "standard", "standard_findings",
]
