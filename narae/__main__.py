"""python -m narae: lints and corrects files. Exit code 1: findings, or changes left to make; 2: wrong use."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narae import api
from narae.functions.catalogue import PROFILES, RULES, SEVERITIES, Config, rule_table
from narae.operators.detect import lint
from narae.operators.fix import fix
from narae.operators.stored import lint_stored
from narae.sources import files

SETTINGS = ".narae.json"
COMMANDS = ("init", "doctor", "completion", "dictionary-validate", "corpus", "feedback")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="narae", description=f"Lints FOLDER or files, or runs one of the commands {', '.join(COMMANDS)}.")
    parser.add_argument("paths", nargs="*", metavar="PATH")
    parser.add_argument("--profile", choices=PROFILES)
    parser.add_argument("--disable", action="append", default=[], metavar="RULE")
    parser.add_argument("--format", choices=("text", "json", "sarif", "markdown"), default="text")
    parser.add_argument("--fail-on", choices=SEVERITIES, default="warning")
    parser.add_argument("--stdin", action="store_true", help="lint what comes in as one plain document")
    parser.add_argument("--changed", action="store_true", help="only files that git sees as changed or new")
    parser.add_argument("--fix", action="store_true", help="write safe corrections back")
    parser.add_argument("--dry-run", action="store_true", help="with --fix: show what would change")
    parser.add_argument("--review", action="store_true", help="with --fix: corrections for review too")
    parser.add_argument("--results", metavar="FOLDER", help="keep findings there, and lint only texts that it lacks")
    parser.add_argument("--rules", action="store_true")
    parser.add_argument("--explain", metavar="RULE")
    return parser


def settings(options: argparse.Namespace) -> Config:
    """The configuration: of the settings file, as far as options don't say otherwise."""
    data = json.load(open(SETTINGS, encoding="utf-8")) if os.path.exists(SETTINGS) else {}
    if options.profile:
        data["profile"] = options.profile
    data["disabledRules"] = [*data.get("disabledRules", []), *options.disable]
    return api.config_of(data)


def documents(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    if options.stdin:
        return spark.createDataFrame([(0, "<stdin>", sys.stdin.read(), "plain_text")], "doc_id long, path string, text string, source_kind string")
    folders = [p for p in options.paths if os.path.isdir(p)]
    found = [f for p in folders for f in files.listed(spark, p)]
    single = [os.path.abspath(p) for p in options.paths if p not in folders]
    for path in single:
        if not os.path.isfile(path):
            raise FileNotFoundError(path)
    if options.changed:
        git = lambda *a: subprocess.run(["git", *a], check=True, capture_output=True, text=True).stdout.split("\0")
        listed = [git("diff", "--name-only", "-z"), git("diff", "--name-only", "--cached", "-z"), git("ls-files", "--others", "--exclude-standard", "-z")]
        tables = [spark.createDataFrame([(p,) for p in rows if p], "path string") for rows in listed]
        changed = {os.path.abspath(r.path) for r in files.changed_files(*tables).collect()}
        plain = lambda p: p.removeprefix("file://").removeprefix("file:")
        found, single = [f for f in found if plain(f) in changed], [f for f in single if f in changed]
    out = files.named(spark, single) if single else files.named(spark, [])
    if found:
        out = out.unionByName(files.texts_of(spark, found))
    return out.dropDuplicates(["path"])


def command(name: str, arguments: list[str], spark: SparkSession | None = None) -> int:
    if name == "init":
        if os.path.exists(SETTINGS):
            print(f"{SETTINGS} is there already", file=sys.stderr)
            return 2
        files.write_atomic(SETTINGS, (json.dumps({"profile": "default", "disabledRules": [], "userDictionary": [], "dictionaryOverlay": []}, indent=2) + "\n").encode())
        return 0
    if name == "completion":
        print(f'complete -W "{" ".join([*COMMANDS, *sorted(o for a in _parser()._actions for o in a.option_strings)])}" narae')
        return 0
    if name == "doctor":
        problems = []
        try:
            config = settings(_parser().parse_args([]))
            problems += [f"no rule {r}" for r in sorted(config.disabled - RULES.keys())]
        except (ValueError, KeyError, TypeError) as error:
            problems.append(f"{SETTINGS}: {error}")
        print("\n".join([f"{len(RULES)} rules, profiles {', '.join(PROFILES)}", *(problems or ["no problems"])]))
        return int(bool(problems))
    if not arguments:
        print(f"{name} needs a file", file=sys.stderr)
        return 2
    if name == "dictionary-validate":
        try:
            found = api.config_of({"dictionaryOverlay": json.load(open(arguments[0], encoding="utf-8"))["entries"]}).overlay
        except (ValueError, KeyError, TypeError) as error:
            print(f"{arguments[0]}: {error}", file=sys.stderr)
            return 1
        print(f"{len(found)} entries")
        return 0
    spark = spark or SparkSession.builder.appName("narae").getOrCreate()
    if name == "feedback":
        for row in files.feedback(spark.read.text(arguments[0])).toJSON().toLocalIterator():
            print(row)
        return 0
    from narae.operators.evaluate import corpus_report

    report, passed = corpus_report(files.read_corpus(spark, arguments[0]), json.load(open(arguments[1], encoding="utf-8")) if len(arguments) > 1 else {})
    print(json.dumps(report, ensure_ascii=False, indent=2))
    return int(not passed)


def main(arguments: list[str]) -> int:
    options = _parser().parse_args(arguments)
    if options.rules:
        print(api.rule_catalogue_markdown() if options.format == "markdown" else api.rule_catalogue_json())
        return 0
    if options.explain:
        try:
            print(api.explain(options.explain))
        except KeyError:
            print(f"no rule {options.explain}", file=sys.stderr)
            return 2
        return 0
    if options.paths and options.paths[0] in COMMANDS and not os.path.exists(options.paths[0]):
        return command(options.paths[0], options.paths[1:])
    if not options.paths and not options.stdin or options.format == "markdown":
        _parser().print_usage(sys.stderr)
        return 2
    spark = SparkSession.builder.appName("narae").getOrCreate()
    try:
        docs, config = documents(spark, options), settings(options)
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    if options.fix:
        fixed = fix(docs, config, options.review)
        if not options.dry_run:
            print(f"{files.write_back(fixed)} files corrected")
            return 0
        rows = fixed.where("text != fixed").select("path", F.explode(files.line_diff(F.col("text"), F.col("fixed"))).alias("d")).orderBy("path", "d.line")
        changes = 0
        for row in rows.toLocalIterator():
            changes += 1
            print(f"{row.path}:{row.d.line}\n- {row.d.before}\n+ {row.d.after}")
        return int(changes > 0)
    found = lint_stored(docs, options.results, config) if options.results else lint(docs, config)
    shown = files.with_lines(found, docs).join(docs.select("doc_id", "path"), "doc_id").join(F.broadcast(rule_table(spark).select("rule_id", "message")), "rule_id")
    if options.format == "sarif":
        for line in files.sarif(shown, list(RULES.values())):
            print(line)
    else:
        ordered = shown.orderBy("path", "start", "end", "rule_id")
        lines = files.report_lines(ordered) if options.format == "text" else ordered.drop("doc_id", "turn").select(F.to_json(F.struct("*")).alias("value"))
        for row in lines.toLocalIterator():
            print(row.value)
    return int(files.fails(found, options.fail_on))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
