"""Rule authoring and corpus policies: seeds to rules, romanised ids, smoke corpora, checks of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narae.functions.catalogue import RULES
from narae.functions.hangul import FIRST, LAST, collapsed

# Latin letters of initials, medials and finals, by number.
INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".split()
MEDIALS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
FINALS = "- k k ks n nj nh t l lk lm lb ls lt lp lh m p ps t t ng t t k t p h".split()


def romanised(text: Column) -> Column:
    """A slug: syllables as Latin letters, other letters and digits in lower case, hyphens for the rest.

    Compatibility forms are left to the caller (see curate.normal_form).
    """
    table = lambda names: F.array(*[F.lit("" if n == "-" else n) for n in names])

    def letter(c: Column) -> Column:
        n = F.ascii(c) - FIRST
        pick = lambda names, k: F.get(table(names), k.cast("int"))
        syllable = F.concat(pick(INITIALS, F.floor(n / 588)), pick(MEDIALS, F.floor(n / 28) % 21), pick(FINALS, n % 28))
        return F.when(F.ascii(c).between(FIRST, LAST), syllable).otherwise(F.lower(c))

    spelled = F.array_join(F.transform(F.split(text, ""), letter), "")
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), F.lit("-"))


def rules_of_seeds(seeds: DataFrame) -> DataFrame:
    """Catalogue rows of seeds (family, wrong, right, confidence, profile): id, severity, safe and default_enabled.

    Severity goes by family; a fix is safe where confidence is high in the default profile.
    """
    family = F.col("family")
    severity = F.when(family.startswith("spelling."), "error").when(family.rlike("^(style|advanced)\\."), "info").otherwise("warning")
    default = F.col("profile") == "default"
    return seeds.select(
        F.concat_ws(".", family, romanised(F.col("right"))).alias("rule_id"), severity.alias("severity"), "confidence", "profile", default.alias("default_enabled"),
        ((F.col("confidence") == "high") & default).alias("safe"), "wrong", "right",
    )


def contained_seeds(seeds: DataFrame) -> DataFrame:
    """(wrong, other): seeds whose pattern has another's in it.

    Every part of a pattern is looked up by an equi-join; patterns are short.
    """
    size = F.char_length("wrong")
    starts = seeds.select("wrong", F.explode(F.sequence(F.lit(1), size)).alias("a"))
    parts = starts.select("wrong", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("wrong") - F.col("a") + 1), lambda n: F.substring(F.col("wrong"), F.col("a"), n))).alias("other")).distinct()
    return parts.where("wrong != other").join(seeds.select(F.col("wrong").alias("other")).distinct(), "other").select("wrong", "other")


def smoke_corpus(spark: SparkSession) -> DataFrame:
    """One case a rule: its first incorrect example, and what is found in it."""
    found, example = {"grammar.ending.deun-choice": 2}, {"grammar.particle.duplicate": "책을을"}
    rows = [(f"bundled-{r.id}", example.get(r.id, r.incorrect[0]), "plain_text", "editorial", [r.id] * found.get(r.id, 1)) for r in RULES.values()]
    return spark.createDataFrame(rows, "id string, text string, source_kind string, profile string, expected_rule_ids array<string>")


@dataclass(frozen=True)
class Policy:
    """What a corpus must have. Zeros and empty tables ask for nothing."""

    exact_cases: int = 0
    least_cases: int = 0
    least_errors: int = 0
    least_normals: int = 0
    least_per_genre: int = 0
    least_text: int = 0
    most_duplicates: int | None = None
    genres: tuple[str, ...] = ()
    source_kinds: tuple[str, ...] = ()
    rule_minimums: tuple[tuple[str, int], ...] = ()
    profile_minimums: tuple[tuple[str, int], ...] = ()


def policy_problems(cases: DataFrame, policy: Policy) -> DataFrame:
    """(problem, subject, found, wanted) of a corpus of (case_id, text, genre, source_kind, profile,
    case_type, expected_rule_ids)."""
    spark = cases.sparkSession
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    facts = cases.agg(F.count(F.lit(1)).alias("cases"), count(F.col("case_type") == "error").alias("errors"), count(F.col("case_type") == "normal").alias("normals"), count(F.char_length("text") < policy.least_text).alias("short"))
    duplicates = cases.groupBy(collapsed(F.col("text"))).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    facts = facts.crossJoin(duplicates)  # one row each
    checks = [
        ("cases", policy.exact_cases, (F.col("cases") != policy.exact_cases) & F.lit(policy.exact_cases > 0)), ("cases", policy.least_cases, F.col("cases") < policy.least_cases),
        ("errors", policy.least_errors, F.col("errors") < policy.least_errors), ("normals", policy.least_normals, F.col("normals") < policy.least_normals), ("short", 0, F.col("short") > 0),
    ]
    if policy.most_duplicates is not None:
        checks.append(("duplicates", policy.most_duplicates, F.col("duplicates") > policy.most_duplicates))
    rows = F.array(*[F.when(F.coalesce(bad, F.lit(wanted > 0)), F.struct(F.lit("total").alias("problem"), F.lit(name).alias("subject"), F.coalesce(F.col(name), F.lit(0)).cast("long").alias("found"), F.lit(wanted).cast("long").alias("wanted"))) for name, wanted, bad in checks])
    out = facts.select(F.explode(F.array_compact(rows)).alias("p")).select("p.*")
    rules = cases.select(F.explode("expected_rule_ids").alias("subject"))
    genres = tuple((g, max(1, policy.least_per_genre)) for g in policy.genres)
    for problem, wanted, have in (
        ("genre", genres, cases.select(F.col("genre").alias("subject"))), ("source kind", tuple((k, 1) for k in policy.source_kinds), cases.select(F.col("source_kind").alias("subject"))),
        ("rule", policy.rule_minimums, rules), ("profile", policy.profile_minimums, cases.select(F.col("profile").alias("subject"))),
    ):
        if wanted:
            asked = spark.createDataFrame(list(wanted), "subject string, wanted long")
            counted = asked.join(have.groupBy("subject").agg(F.count(F.lit(1)).alias("found")), "subject", "left").select(F.lit(problem).alias("problem"), "subject", F.coalesce("found", F.lit(0)).alias("found"), "wanted")
            out = out.unionByName(counted.where("found < wanted"))
    return out


def gate_report(metrics: DataFrame, failures: DataFrame, completed: bool = True) -> dict:
    """A report of one row of metrics and the gates that failed."""
    failed = [r.asDict() for r in failures.collect()]  # a row a gate
    return {"schemaVersion": 1, "passed": completed and not failed, "qualityGate": {"passed": not failed, "failures": failed}, "metrics": metrics.first().asDict()}


def bundle_problems(described: DataFrame, content: DataFrame) -> DataFrame:
    """(name, problem): files of a bundle whose digest is not the one described (name, sha256), or that are missing."""
    joined = described.join(content.select("name", F.sha2("content", 256).alias("actual")), "name", "left")
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "digest")
    return joined.select("name", problem.alias("problem")).where("problem is not null")


def benchmark_texts(spark: SparkSession, sizes: dict[str, int], kinds: tuple[str, ...] = ("plain_text", "markdown", "typescript")) -> DataFrame:
    """(id, source_kind, byte_length, text): deterministic texts of exact sizes, padded with blanks."""
    subjects, actions = ["편집자가", "검토자가", "작성자가"], ["문장을 다시 읽었다", "근거를 함께 적었다", "결과를 나란히 보았다"]

    def record(kind: str, k: int) -> str:
        sentence = f"{subjects[k % 3]} {actions[k // 3 % 3]}."
        return {"markdown": f"## 기록 {k}\n\n- {sentence} `code_{k}`\n", "typescript": f'const r{k} = "{k}"; // {sentence}\n'}.get(kind, f"[{k}] {sentence}\n")

    rows = []
    for kind in kinds:
        for name, size in sizes.items():
            text, k = "", 0
            while len((text + record(kind, k)).encode()) <= size:
                text, k = text + record(kind, k), k + 1
            rows.append((f"{kind}-{name}", kind, size, text + " " * (size - len(text.encode()))))
    return spark.createDataFrame(rows, "id string, source_kind string, byte_length long, text string")
