"""Registered queries and the SQL that DuckDB runs against them.

Queries over Korean rules read whole ``documents`` with sentences of ours behind them; all others
read the driver's tables as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narae.functions import hangul
from narae.functions.catalogue import PROFILES, RULES, Config, PackRule, Pattern, boundary_of, literal_table, rule_pack, rule_table
from narae.functions.rule_tables import FORMS, LITERALS
from narae.operators import authoring, candidates, curate, detect, evaluate
from narae.operators.fix import accepted, applied
from narae.operators.groups import similar_groups
from narae.operators.stored import lint_stored
from narae.plans.fixture import KOREAN, korean_documents
from narae.session import materialise, scratch_path
from narae.sources import files
from narae.operators.standard import tokens_in_ranges, with_parts_of_speech
from narae.sources.tokens import range_table, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALL = Config("editorial")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- findings --------------------------------------------------------------------------------


def _shown(found: DataFrame) -> DataFrame:
    names = {"start": "start_cp", "end": "end_cp", "byte_start": "start_byte", "byte_end": "end_byte"}
    return found.select("doc_id", *[F.col(a).cast("long").alias(b) for a, b in names.items()], "original", "suggestion", "rule_id")


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _table(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _list([v]) for v in r) + ")" for r in rows)


#: Bodies of the form (doc_id, text, place, original, suggestion, rule_id) over KOREAN.
BODY: dict[str, str] = {}
_PLACES = "(SELECT *, substr(tail, off + 1, 40) AS rest40 FROM (SELECT *, substr(text, start + 1, 80) AS tail, unnest(generate_series(0, length(word) - 1)) AS off FROM words))"
_LITERALS = [(n, a, b, boundary_of(n)) for n, _, _, _, pairs in LITERALS for a, b in pairs if a != ",,"] + [(n, a, b, "substring") for n, _, a, b in FORMS if a[0] != " " and n != "grammar.particle.duplicate"]
BODY["literals"] = f"""
SELECT doc_id, text, start + off AS place, wrong AS original, good AS suggestion, rule_id
FROM {_PLACES} w JOIN (VALUES {_table(_LITERALS)}) r(rule_id, wrong, good, boundary)
  ON starts_with(rest40, wrong)
WHERE boundary = 'substring' OR (off = 0 AND NOT regexp_matches(gap, '[\\p{{L}}\\p{{N}}_]$'))"""
BODY["doubled_particles"] = """
SELECT doc_id, text, start + length(word) - 2 AS place, right(word, 2) AS original, right(word, 1) AS suggestion, 'grammar.particle.duplicate' AS rule_id
FROM (SELECT *, length(regexp_extract(word, '(를+|을+|은+|는+)$')) AS run FROM words)
WHERE run >= 2 AND run % 2 = 0 AND length(word) > 2"""
BODY["doe_to_dwae"] = f"""
SELECT doc_id, text, start + off AS place, wrong AS original, good AS suggestion, 'grammar.conjugation.doe-to-dwae' AS rule_id
FROM {_PLACES} JOIN (VALUES {_table(detect.DOE_FORMS)}) r(wrong, good) ON substr(word, off + 1, length(wrong)) = wrong
UNION ALL SELECT doc_id, text, start, word, '돼도', 'grammar.conjugation.doe-to-dwae' FROM words WHERE word = '되도'"""
BODY["dwae_to_doe"] = """
SELECT doc_id, text, start AS place, word AS original, regexp_replace(word, '돼(게|게요|면|고|는|겠|면서|도록)$', '되\\1') AS suggestion, 'grammar.conjugation.dwae-to-doe' AS rule_id
FROM words WHERE regexp_matches(word, '돼(게|게요|면|고|는|겠|면서|도록)$')"""


def _first_form(forms, rule: str) -> str:
    return f"""
SELECT doc_id, text, start AS place, word AS original, substr(word, 1, p - 1) || good || substr(word, p + length(wrong)) AS suggestion, '{rule}' AS rule_id
FROM (SELECT *, instr(word, wrong) AS p FROM words, (VALUES {_table(forms)}) r(wrong, good))
WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY p, -length(wrong)) = 1"""


BODY["euryeo"] = _first_form(detect.EURYEO_FORMS, "grammar.ending.euryeo")
BODY["euryeo_context"] = _first_form(detect.EURYEO_CONTEXT, "grammar.ending.euryeo-context")
BODY["colloquial_yong"] = """
SELECT doc_id, text, start AS place, word AS original, left(word, length(word) - 1) || '요' AS suggestion, 'grammar.ending.colloquial-yong' AS rule_id
FROM words WHERE word LIKE '%해용' OR word LIKE '%세용'"""
BODY["seumnida"] = """
SELECT doc_id, text, start AS place, word AS original,
  CASE WHEN (ord(right(stem, 1)) - 44032) % 28 IN (0, 8)
       THEN left(stem, length(stem) - 1) || chr(44032 + CAST(floor((ord(right(stem, 1)) - 44032) / 28) AS INTEGER) * 28 + 17) || right(word, 2)
       ELSE stem || '습' || right(word, 2) END AS suggestion, 'grammar.ending.seumnida' AS rule_id
FROM (SELECT *, left(word, length(word) - 3) AS stem FROM words WHERE (word LIKE '%읍니다' OR word LIKE '%읍니까') AND length(word) > 3)"""
BODY["sipsio"] = """
SELECT doc_id, text, start AS place, word AS original, left(word, length(word) - 1) || '오' AS suggestion, 'grammar.ending.sipsio' AS rule_id
FROM words WHERE word LIKE '%십시요'"""
BODY["anieyo"] = """
SELECT doc_id, text, start AS place, word AS original, '아니에요' AS suggestion, 'grammar.copula.anieyo' AS rule_id FROM words WHERE word = '아니예요'"""
BODY["anh_doe"] = """
SELECT doc_id, text, start AS place, word AS original, '안 ' || substr(word, 2) AS suggestion, 'grammar.negation.anh-doe' AS rule_id
FROM words WHERE regexp_matches(word, '^않(되|돼|된|될|됨|됩|됐)') AND word <> '않되'"""
_FINAL = "(ord(right(stem, 1)) - 44032) % 28"
_ADNOMINAL = "right(stem, 1) IN ('은', '는', '을')"
_NOUNS = [
    ("de", "데", f"stem <> '쓸' AND {_FINAL} = 8 AND regexp_matches(rest, '^(가|를|도|는|에|까지|마다)')"),
    ("chae", "채", f"stem <> '산' AND {_FINAL} = 4 AND starts_with(rest, '로')"),
    ("deut", "듯", f"NOT regexp_matches(stem, '(그럴|번|반)$') AND ({_ADNOMINAL} OR {_FINAL} IN (4, 8)) AND regexp_matches(rest, '^(하|싶|이)')"),
    ("mankeum", "만큼", f"stem NOT IN ('마을', '가을', '노을', '은') AND {_ADNOMINAL}"),
    ("daero", "대로", f"stem NOT IN ('마을', '가을', '노을') AND {_ADNOMINAL}"),
    ("beop", "법", "right(stem, 1) = '는' AND regexp_matches(rest, '^(이|입|도)')"),
    ("ri", "리", f"stem NOT IN ('물', '멀', '빨', '랠', '칼') AND {_FINAL} = 8 AND regexp_matches(rest, '^(가|는|도)') AND regexp_full_match(then_gap, '\\s+') AND starts_with(next, '없')"),
]
BODY["dependent_nouns"] = " UNION ALL ".join(
    f"""SELECT doc_id, text, start AS place, word AS original, stem || ' {noun}' || rest AS suggestion, 'spacing.dependent-noun.{key}' AS rule_id
FROM (SELECT *, regexp_extract(word, '^(.+){noun}(.*)$', 1) AS stem, regexp_extract(word, '^(.+){noun}(.*)$', 2) AS rest FROM words WHERE contains(word, '{noun}'))
WHERE stem <> '' AND {holds}"""
    for key, noun, holds in _NOUNS
)
BODY["deun_choice"] = """
SELECT doc_id, text, start AS place, word AS original, left(word, length(word) - 2) || '든지' AS suggestion, 'grammar.ending.deun-choice' AS rule_id
FROM words WHERE word LIKE '%던지' AND contains(coalesce(next, ''), '던지') AND regexp_full_match(then_gap, '\\s+')
UNION ALL SELECT doc_id, text, start, left(word, instr(word, '던지') + 1), left(word, instr(word, '던지') - 1) || '든지', 'grammar.ending.deun-choice'
FROM words WHERE contains(word, '던지') AND coalesce(prev, '') LIKE '%던지' AND i > 1 AND regexp_full_match(gap, '\\s+')"""
_PARTICLES = []
for _name, _wrong, _right in detect.AFTER_FINAL:
    _closed = "(ord(right(noun, 1)) - 44032) % 28 > 0 AND right(noun, 1) <> '" + _wrong + "'" + (" AND (ord(right(noun, 1)) - 44032) % 28 <> 8" if _name == "instrumental" else "")
    _PARTICLES.append((_name, _wrong, _right, f"starts_with(rest, '{_wrong}') AND {_closed}" + (f" AND noun IN ({_list(detect.PARTICLE_NOUNS)})" if _name == "topic" else "")))
_ENDS = "(then_gap = '' OR regexp_matches(then_gap, '^[\\s,.!?…:;)\\]}”’]'))"
for _name, _wrong, _right in [*detect.AFTER_VOWEL, ("subject", "이", "가")]:
    _nouns = detect.SUBJECT_NOUNS if _name == "subject" else detect.PARTICLE_NOUNS
    _PARTICLES.append((_name, _wrong, _right, f"rest = '{_wrong}' AND noun IN ({_list(_nouns)}) AND (ord(right(noun, 1)) - 44032) % 28 = 0 AND {_ENDS}"))
BODY["particles"] = " UNION ALL ".join(
    f"""SELECT doc_id, text, start AS place, noun || '{wrong}' AS original, noun || '{right}' AS suggestion, 'grammar.particle.{name}-allomorph' AS rule_id
FROM (SELECT *, left(word, off) AS noun, substr(word, off + 1) AS rest FROM {_PLACES} WHERE off > 0) WHERE {holds}"""
    for name, wrong, right, holds in _PARTICLES
)


def _runs(pattern: str) -> str:
    """(doc_id, text, k, run, place, before, after) of all matches of a pattern in Korean documents."""
    return f"""(SELECT *, right(pieces[k], 1) AS before, left(pieces[k + 1], 1) AS after,
  CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS place, found[k] AS run
  FROM (SELECT *, unnest(generate_series(1, len(found))) AS k FROM (SELECT doc_id, text, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS found FROM ko)))"""


BODY["commas"] = f"""
SELECT doc_id, text, place, run AS original, CASE WHEN regexp_matches(after, '[가-힣]') THEN ', ' ELSE ',' END AS suggestion, 'punctuation.duplicate.comma' AS rule_id
FROM {_runs(',+')} WHERE length(run) > 1
UNION ALL SELECT doc_id, text, place, ',', ', ', 'punctuation.space-after-comma' FROM {_runs(',+')} WHERE length(run) = 1 AND regexp_matches(after, '[가-힣]')"""
BODY["sentence_marks"] = f"""
SELECT doc_id, text, place, left(run, 1) AS original, left(run, 1) || ' ' AS suggestion, 'punctuation.space-after-sentence-mark' AS rule_id
FROM {_runs('[.!?][가-힣]')} WHERE NOT regexp_matches(before, '[0-9]')"""
BODY["blanks_before_marks"] = f"""
SELECT doc_id, text, place, left(run, length(run) - 1) AS original, '' AS suggestion, 'punctuation.no-space-before-mark' AS rule_id
FROM {_runs('[ \\t]+[.!?]')}"""
BODY["repeated_words"] = """
SELECT doc_id, text, start AS place, word || then_gap || word AS original, word AS suggestion, 'repetition.adjacent-word' AS rule_id
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY i) AS turn
      FROM (SELECT *, sum(CASE WHEN word = prev AND i > 1 AND regexp_full_match(gap, '\\s+') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM words))
WHERE turn % 2 = 1 AND next = word AND regexp_full_match(then_gap, '\\s+') AND word <> '그때'"""


def _body_sql(names) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({BODY[n]})" for n in names)


def _finding_sql(names, where: str = "TRUE") -> str:
    return f"""WITH {KOREAN}, f AS ({_body_sql(names)})
SELECT doc_id, CAST(place AS BIGINT) AS start_cp, CAST(place + length(original) AS BIGINT) AS end_cp,
  CAST(strlen(substr(text, 1, CAST(place AS BIGINT))) AS BIGINT) AS start_byte, CAST(strlen(substr(text, 1, CAST(place AS BIGINT))) + strlen(original) AS BIGINT) AS end_byte,
  original, suggestion, rule_id FROM f WHERE {where}"""


def _detector(name: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(detect.DETECTORS[name](tokens(korean_documents(spark, sf_dir)), ALL))

    return run


for _name in detect.DETECTORS:
    QUERIES[f"lint_{_name}"] = _detector(_name)
    SQL[f"lint_{_name}"] = _finding_sql([_name])


@query(f"WITH {KOREAN}, f AS ({_body_sql(BODY)}) SELECT rule_id, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM f GROUP BY rule_id")
def lint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules, by rule: the flagship."""
    found = detect.lint(korean_documents(spark, sf_dir), ALL)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"))


@query(f"WITH {KOREAN}, f AS ({_body_sql(BODY)}) SELECT rule_id, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM f GROUP BY rule_id")
def lint_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules by rule, of which those of English documents come from an earlier run's store."""
    docs, folder = korean_documents(spark, sf_dir), scratch_path(spark, "results")
    lint_stored(docs.where("lang = 'en'"), folder, ALL)
    found = lint_stored(docs, folder, ALL)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"))


_DEFAULT = sorted(r.id for r in RULES.values() if PROFILES[r.profile] == 0)


@query(_finding_sql(BODY, f"rule_id IN ({_list(_DEFAULT)}) AND rule_id NOT IN ('grammar.ending.euryeo', 'spelling.lexical.geumse')"))
def lint_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the default profile with two rules disabled."""
    return _shown(detect.lint(korean_documents(spark, sf_dir), Config("default", frozenset({"grammar.ending.euryeo", "spelling.lexical.geumse"}))))


@query(_finding_sql(BODY, "NOT ((starts_with(rule_id, 'spelling.lexical.') OR rule_id = 'spelling.loanword.curated') AND original IN ('몇일', '메세지'))"))
def lint_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without those on words of a user dictionary and an overlay."""
    return _shown(detect.lint(korean_documents(spark, sf_dir), Config("editorial", dictionary=frozenset({"몇일"}), overlay={"메세지": "noun"})))


PACK = rule_pack({
    "version": 1, "language": "ko",
    "rules": [
        {"id": "pack.words", "severity": "info", "message": "house style", "replacements": [{"from": "그리고", "to": "또", "boundary": "word"}, {"from": "하지만", "to": "그러나", "boundary": "prefix"}]},
        {"id": "pack.latin", "severity": "warning", "message": "house style", "safe_fix": True, "replacements": [{"from": "the", "to": "The", "boundary": "suffix"}, {"from": "anan", "to": "an", "boundary": "substring"}]},
    ],
})


@query(f"""WITH {KOREAN}, r(rule_id, wrong, boundary) AS (VALUES {_table([(r.id, p.wrong, p.boundary) for r in PACK for p in r.patterns])}),
pieces AS (SELECT doc_id, rule_id, wrong, boundary, string_split(text, wrong) AS p FROM ko JOIN r ON contains(text, wrong)),
cuts AS (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM pieces),
near AS (SELECT rule_id, wrong, boundary, doc_id,
  regexp_matches(CASE WHEN p[k] = '' AND k > 1 THEN wrong ELSE p[k] END, '[\\p{{L}}\\p{{N}}_]$') AS joined_left,
  regexp_matches(CASE WHEN p[k + 1] = '' AND k + 1 < len(p) THEN wrong ELSE p[k + 1] END, '^[\\p{{L}}\\p{{N}}_]') AS joined_right FROM cuts)
SELECT rule_id, wrong AS original, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM near
WHERE boundary = 'substring' OR (boundary = 'word' AND NOT joined_left AND NOT joined_right) OR (boundary = 'prefix' AND NOT joined_left) OR (boundary = 'suffix' AND NOT joined_right)
GROUP BY rule_id, wrong""")
def lint_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a rule pack, by pattern."""
    found = detect.pack_findings(korean_documents(spark, sf_dir), PACK, ALL)
    return found.groupBy("rule_id", "original").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"))


#: Boundaries of the patterns of word_pack, in turn.
_TURNS = ["substring", "word", "prefix", "suffix"]


def word_pack(spark: SparkSession, sf_dir: str, most: int = 1000) -> list:
    """A rule pack of the commonest words of three letters and more: they contain each other, and overlap."""
    words = curate.word_frequencies(_read(spark, sf_dir, "documents"), r"\p{L}{3,}", 1).orderBy(F.desc("frequency"), "surface").limit(most)
    found = [r.surface for r in words.collect()]
    return [PackRule(f"pack.{b}", "info", "a common word", tuple(Pattern(w, w + "!", b) for w in found[k :: len(_TURNS)])) for k, b in enumerate(_TURNS)]


_SAFE = sorted(r.id for r in RULES.values() if r.safety == "safe")


@query(f"""WITH RECURSIVE {KOREAN}, f AS ({_body_sql(BODY)}),
safe AS MATERIALIZED (SELECT doc_id, CAST(place AS BIGINT) AS a, CAST(place + length(original) AS BIGINT) AS b, suggestion,
         row_number() OVER (PARTITION BY doc_id ORDER BY place, place + length(original), rule_id, suggestion) AS k FROM f WHERE rule_id IN ({_list(_SAFE)})),
walk AS (
  SELECT doc_id, text, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS at_, '' AS out FROM ko
  UNION ALL
  SELECT w.doc_id, w.text, s.k, CASE WHEN s.a >= w.at_ THEN s.b ELSE w.at_ END,
         CASE WHEN s.a >= w.at_ THEN w.out || substr(w.text, w.at_ + 1, s.a - w.at_) || s.suggestion ELSE w.out END
  FROM walk w JOIN safe s ON s.doc_id = w.doc_id AND s.k = w.k + 1)
SELECT doc_id, sha256(out || substr(text, at_ + 1)) AS fixed_sha256, k AS edits
FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1""")
def fix_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of safe corrections: the digest of each text, and how many safe findings it had."""
    docs = korean_documents(spark, sf_dir)
    found = materialise(detect.lint(docs, ALL), "findings")
    counts = found.where("safe").groupBy("doc_id").agg(F.count(F.lit(1)).alias("edits"))
    fixed = applied(docs, accepted(found)).join(counts, "doc_id", "left")
    return fixed.select("doc_id", F.sha2("fixed", 256).alias("fixed_sha256"), F.coalesce("edits", F.lit(0)).alias("edits"))


@query()
def fix_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe corrections to a fixpoint. (Not in SQL: each pass lints anew.)"""
    from narae.operators.fix import fix

    return fix(korean_documents(spark, sf_dir), ALL).select("doc_id", F.sha2("fixed", 256).alias("fixed_sha256"), (F.col("fixed") != F.col("text")).alias("changed"))


# --- ranges, tokens, characters --------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\s+')) AS token FROM documents),
u AS (SELECT doc_id, rtrim(ltrim(token, '"''()[]{}<>“”‘’'), '"''()[]{}<>“”‘’.,!?;:') AS w FROM t)
SELECT doc_id, CAST(count(*) FILTER (ident) AS BIGINT) AS identifiers, CAST(coalesce(sum(length(w)) FILTER (ident), 0) AS BIGINT) AS identifier_chars
FROM (SELECT *, w <> '' AND (contains(w, '://') OR contains(w, '@') OR contains(w, '/') OR contains(w, '\') OR starts_with(w, 'www.')
  OR regexp_full_match(w, '(?s).+\.[A-Za-z0-9_-]{1,63}[가-힣]*') OR (starts_with(w, '#') AND strlen(w) > 1)) AS ident FROM u) GROUP BY doc_id""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept out of linting in each document."""
    docs = _read(spark, sf_dir, "documents")
    ranges = range_table(docs).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("prose"), F.count(F.lit(1)).alias("ranges"), F.min("start").alias("first"), F.max("end").alias("last"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    joined = docs.join(ranges, "doc_id", "left")
    # Between two ranges, before the first and after the last lies one identifier each.
    n = F.when(F.col("ranges").isNull(), (size > 0).cast("long")).otherwise(F.col("ranges") - 1 + (F.col("first") > 0).cast("long") + (F.col("last") < size).cast("long"))
    return joined.select("doc_id", n.cast("long").alias("identifiers"), (size - F.coalesce("prose", F.lit(0))).cast("long").alias("identifier_chars"))


SOURCES = [
    ("markdown", "글 `코드` 글\n```\n코드\n```\n[이름](http://a.b) 끝\n"), ("python", "a = '글' # 주석\n'''글 # 글''' # 둘\n"),
    ("javascript", "a / b // 하나\n/re\\/x/.test(`t${ 1 /* 둘 */ }`) // 셋\n"), ("rust", "let s = r#\"// \"#; /* 하나 /* 둘 */ */ 'a' // 셋\n"),
]


#: Ranges and bytes of prose in each frame by hand; marks of comments are identifiers, as they have a slash.
_FRAMES = [(4, 22, "글"), (2, 13, "#"), (3, 16, "//"), (4, 18, "//")]
_MARKUP = r"[\s`<>\[\]!~\\*]+"


def _core(token: str) -> str:
    return f"""rtrim(ltrim({token}, '"''()[]{{}}<>“”‘’'), '"''()[]{{}}<>“”‘’.,!?;:')"""


def _is_identifier(c: str) -> str:
    return f"""({c} <> '' AND (contains({c}, '://') OR contains({c}, '@') OR contains({c}, '/') OR contains({c}, '\\') OR starts_with({c}, 'www.')
  OR regexp_full_match({c}, '(?s).+\\.[A-Za-z0-9_-]{{1,63}}[가-힣]*') OR (f = 0 AND starts_with({c}, '#') AND length({c}) > 1)))"""


@query(f"""WITH k(f, ranges, bytes, mark) AS (VALUES {_table([(k, *x) for k, x in enumerate(_FRAMES)])}),
l AS (SELECT doc_id, f, ranges, bytes, mark || ' ' || regexp_replace(coalesce(text, ''), '{_MARKUP}', ' ', 'g') AS line FROM documents JOIN k ON doc_id % {len(_FRAMES)} = f),
t AS (SELECT doc_id, f, {_core('token')} AS c FROM (SELECT doc_id, f, unnest(string_split(line, ' ')) AS token FROM l)),
n AS (SELECT doc_id, count(*) AS n, sum(strlen(c)) AS b FROM t WHERE {_is_identifier('c')} GROUP BY doc_id),
e AS (SELECT *, {_core("string_split(line, ' ')[-1]")} AS last FROM l)
SELECT doc_id, CAST(ranges + 1 + coalesce(n, 0) - CASE WHEN f >= 2 THEN 1 ELSE 0 END - CASE WHEN {_is_identifier('last')} AND ends_with(line, last) THEN 1 ELSE 0 END AS BIGINT) AS ranges,
  CAST(bytes + strlen(line) - coalesce(b, 0) AS BIGINT) AS prose_bytes FROM e LEFT JOIN n USING (doc_id)""")
def source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose of documents that stand, without markup, in Markdown and in comments of three kinds of programs."""
    kinds = spark.createDataFrame([(k, *s, mark) for k, (s, (_, _, mark)) in enumerate(zip(SOURCES, _FRAMES))], "k int, source_kind string, frame string, mark string")
    docs = _read(spark, sf_dir, "documents").join(F.broadcast(kinds), F.pmod(F.col("doc_id"), F.lit(len(SOURCES))) == F.col("k"))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), _MARKUP, " ")
    docs = docs.select("doc_id", "source_kind", F.concat("frame", "mark", F.lit(" "), plain).alias("text"))
    return range_table(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("prose_bytes"))


@query(f"""WITH {KOREAN}, a AS (SELECT doc_id, start AS at_, start + length(word) - CASE WHEN start % 3 = 0 THEN 1 ELSE 0 END AS stop, 'p' || length(word) AS pos FROM words WHERE length(word) > 1)
SELECT w.doc_id, w.start AS start_cp, w.word AS surface, a.pos FROM words w LEFT JOIN a ON a.doc_id = w.doc_id AND a.at_ = w.start AND a.stop = w.start + length(w.word)""")
def analysed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the part of speech of the analysed token at just their place; a third of the tokens ends short."""
    docs = korean_documents(spark, sf_dir)
    words = tokens(docs).where("kind = 'word'").select("doc_id", "start", "surface")
    size = F.char_length("surface")
    analysed = words.where(size > 1).select("doc_id", "start", (F.col("start") + size - F.when(F.col("start") % 3 == 0, 1).otherwise(0)).alias("end"), F.concat(F.lit("p"), size.cast("string")).alias("pos"))
    found = with_parts_of_speech(words, tokens_in_ranges(analysed, range_table(docs)))
    return found.select("doc_id", F.col("start").alias("start_cp"), "surface", "pos")


@query(f"WITH {KOREAN} SELECT doc_id, start AS start_cp, word AS surface FROM words")
def hangul_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens(korean_documents(spark, sf_dir)).where("kind = 'word'")
    return found.select("doc_id", F.col("start").alias("start_cp"), "surface")


@query(f"""WITH {KOREAN}, c AS (SELECT DISTINCT unnest(string_split(word, '')) AS syllable FROM words), n AS (SELECT syllable, ord(syllable) - 44032 AS n FROM c)
SELECT syllable, CAST(floor(n / 588) AS INTEGER) AS initial, CAST(floor(n / 28) AS INTEGER) % 21 AS medial, n % 28 AS final, chr(44032 + n - n % 28) AS open_form FROM n""")
def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each syllable, and the syllable without its final, composed anew."""
    found = tokens(korean_documents(spark, sf_dir)).where("kind = 'word'").select(F.explode(F.split("surface", "")).alias("syllable")).distinct()
    p = found.withColumn("p", hangul.parts(F.col("syllable")))
    return p.select("syllable", "p.initial", "p.medial", "p.final", hangul.compose(F.col("p.initial"), F.col("p.medial"), F.lit(0)).alias("open_form"))


@query(f"""WITH {KOREAN}, f AS ({BODY['literals']})
SELECT doc_id, rule_id, CAST(place AS BIGINT) AS start_cp, length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(string_split(before, chr(10))[-1]) + 1 AS "column"
FROM (SELECT *, substr(text, 1, CAST(place AS BIGINT)) AS before FROM f)""")
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of the literal findings."""
    docs = korean_documents(spark, sf_dir)
    shown = files.with_lines(detect.literals(tokens(docs), ALL), docs)
    return shown.select("doc_id", "rule_id", F.col("start").cast("long").alias("start_cp"), F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"))


def _has(needles) -> str:
    return " OR ".join(f"contains(text, '{n}')" for n in needles)


@query(f"""WITH {KOREAN} SELECT doc_id, CASE {' '.join(f"WHEN {_has(n)} THEN '{s}'" for s, n in candidates.STYLES)} ELSE 'plain' END AS profile,
CAST(greatest(length(text) - length(translate(text, '.?!。？！', '')), 1) AS BIGINT) AS sentence_count, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS digest FROM ko""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style, sizes and digest of each document."""
    docs = korean_documents(spark, sf_dir).withColumn("s", candidates.style(F.col("text")))
    return docs.select("doc_id", "s.profile", F.col("s.sentence_count").cast("long").alias("sentence_count"), F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))


@query("""SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normal, len(list_distinct(CASE WHEN length(n) < 5 THEN [n] ELSE list_transform(generate_series(1, length(n) - 4), lambda i: substr(n, i, 5)) END)) AS grams
FROM (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM conversations)""")
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    normal = hangul.normalised(F.col("text"))
    return rows.select("conv_id", "turn", normal.alias("normal"), F.size(hangul.grams(normal, 5)).cast("long").alias("grams"))


@query("""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
h AS (SELECT *, (SELECT coalesce(max(k), 0) FROM unnest(generate_series(1, least(length(a), length(b)))) t(k) WHERE left(a, k) = left(b, k)) AS head FROM p WHERE b IS NOT NULL),
s AS (SELECT *, (SELECT coalesce(max(k), 0) FROM unnest(generate_series(1, least(length(a), length(b)) - head)) t(k) WHERE right(a, k) = right(b, k)) AS tail FROM h)
SELECT conv_id, turn, head AS start_cp, length(a) - tail AS end_cp, substr(a, head + 1, length(a) - head - tail) AS original, substr(b, head + 1, length(b) - head - tail) AS replacement FROM s""")
def changed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between a turn and the next."""
    rows = _read(spark, sf_dir, "conversations").withColumn("b", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    s = rows.withColumn("s", hangul.changed_span(F.col("text"), F.col("b")))
    return s.select("conv_id", "turn", F.col("s.start").cast("long").alias("start_cp"), F.col("s.end").cast("long").alias("end_cp"), F.col("s.before").alias("original"), F.col("s.after").alias("replacement"))


@query(f"""WITH t AS (SELECT unnest(string_split_regex(coalesce(text, ''), '\\s+')) AS token FROM documents),
g AS (SELECT token, count(*) AS n FROM (SELECT token, 0 AS f, {_core('token')} AS c FROM t) WHERE NOT {_is_identifier('c')} GROUP BY token),
w AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS k FROM (SELECT unnest(regexp_extract_all(text, '\\p{{L}}{{3,}}')) AS w FROM documents) GROUP BY w QUALIFY k < 1000),
r AS (SELECT w AS wrong, ['substring', 'word', 'prefix', 'suffix'][k % 4 + 1] AS boundary FROM w),
pieces AS (SELECT wrong, boundary, n, string_split(token, wrong) AS p FROM g JOIN r ON contains(token, wrong)),
cuts AS (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM pieces),
near AS (SELECT wrong, boundary, n,
  regexp_matches(CASE WHEN p[k] = '' AND k > 1 THEN wrong ELSE p[k] END, '[\\p{{L}}\\p{{N}}_]$') AS joined_left,
  regexp_matches(CASE WHEN p[k + 1] = '' AND k + 1 < len(p) THEN wrong ELSE p[k + 1] END, '^[\\p{{L}}\\p{{N}}_]') AS joined_right FROM cuts)
SELECT wrong AS original, boundary, CAST(sum(n) AS BIGINT) AS findings FROM near
WHERE boundary = 'substring' OR (boundary = 'word' AND NOT joined_left AND NOT joined_right) OR (boundary = 'prefix' AND NOT joined_left) OR (boundary = 'suffix' AND NOT joined_right)
GROUP BY wrong, boundary""")
def lint_word_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a pack of a thousand patterns made from the documents' own words, by pattern."""
    found = detect.pack_findings(_read(spark, sf_dir, "documents"), word_pack(spark, sf_dir), ALL)
    return found.groupBy("original", F.replace("rule_id", F.lit("pack.")).alias("boundary")).agg(F.count(F.lit(1)).alias("findings"))


# --- candidates and ranking ------------------------------------------------------------------

LEXICON = [("며칠", "noun", 900), ("동안", "noun", 700), ("지쳤고", "verb", 50), ("데이터", "noun", 800), ("베이스", "noun", 300), ("데이터베이스", "noun", 400), ("문서", "noun", 600), ("역할", "noun", 500), ("만날", "verb", 90), ("때", "noun", 1000), ("확인", "noun", 450), ("사과", "noun", 350), ("여기", "noun", 640), ("빈칸", "noun", 80), ("사는", "verb", 70), ("법이다", "noun", 60)]
_LEX = f"lex(surface, pos, freq) AS (VALUES {_table(LEXICON)})"


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "surface string, pos string, freq long")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(korean_documents(spark, sf_dir)).where("kind = 'word'")


def _near(words: str, entries: str) -> str:
    """Table near (word, replacement, edits, sounds, score): the 32 best entries of each word, from all pairs.

    DuckDB's levenshtein counts bytes, so the characters of a pair are numbered first. Tables: (word), (surface, freq).
    """
    numbered = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda x: chr(CAST(list_position(letters, x) + 40 AS INTEGER))), '')"
    code = lambda c: f"(ord(substr({c}, k, 1)) - 44032)"
    hangul = " AND ".join(f"{code(c)} BETWEEN 0 AND 11171" for c in ("word", "surface"))
    part = lambda f: f"CASE WHEN {f.format(code('word'))} <> {f.format(code('surface'))} THEN 1 ELSE 0 END"
    parts = " + ".join(map(part, ("floor({} / 588)", "floor({} / 28) % 21", "{} % 28")))
    apart = f"CASE WHEN {hangul} THEN {parts} ELSE CASE WHEN substr(word, k, 1) <> substr(surface, k, 1) THEN 1 ELSE 0 END END"
    return f"""pairs AS (SELECT word, surface, freq, list_distinct(string_split(word || surface, '')) AS letters FROM {words} w JOIN {entries} e
  ON abs(length(word) - length(surface)) <= 1 WHERE length(word) >= 2 AND word NOT IN (SELECT surface FROM {entries})),
close AS (SELECT word, surface, freq, CASE WHEN strlen(word) = length(word) AND strlen(surface) = length(surface) THEN levenshtein(word, surface) ELSE levenshtein({numbered('word')}, {numbered('surface')}) END AS edits FROM pairs),
heard AS (SELECT word, surface, freq, edits, (SELECT CAST(sum({apart}) AS INTEGER) FROM unnest(generate_series(1, least(length(word), length(surface)))) t(k)) AS sounds FROM close WHERE edits <= 2),
near AS (SELECT word, surface AS replacement, edits, sounds, least(1.0, 1 / (1 + edits) + 0.35 / (1 + sounds) + least(ln(freq + 1), 16.0) / 64) AS score
  FROM heard QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, surface) <= {candidates.PER_WORD})"""


@query(f"""WITH {KOREAN}, {_LEX}, asked AS (SELECT DISTINCT word FROM words), {_near('asked', 'lex')}
SELECT doc_id, start AS start_cp, word AS original, replacement, CAST(edits AS INTEGER) AS edits, round(score, 9) AS score FROM words JOIN near USING (word)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start, start + length(word), replacement) <= 32""")
def near_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near lexicon words for unknown ones, the 32 best of a document."""
    found = candidates.spelling_candidates(_words(spark, sf_dir), _lexicon(spark))
    return found.select("doc_id", F.col("start").alias("start_cp"), "original", "replacement", "edits", F.round("score", 9).alias("score"))


_LETTERS = "\\p{L}{2,}"


@query(f"""WITH lex AS (SELECT surface, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '{_LETTERS}')) AS surface FROM conversations) GROUP BY surface),
asked AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_LETTERS}')) AS word FROM benchmark), {_near('asked', 'lex')}
SELECT word, replacement, CAST(edits AS INTEGER) AS edits, sounds, round(score, 9) AS score FROM near""")
def near_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of benchmark items that no conversation has, and the nearest of all words of conversations."""
    lexicon = curate.word_frequencies(_read(spark, sf_dir, "conversations"), _LETTERS, 1).withColumnRenamed("frequency", "freq")
    words = curate.word_frequencies(_read(spark, sf_dir, "benchmark"), _LETTERS, 1)
    found = candidates.near_words(words.select("surface"), materialise(lexicon, "lexicon"))
    return found.select("word", "replacement", "edits", "sounds", F.round("score", 9).alias("score"))


_SPLIT = """SELECT doc_id, start, word AS original, l.surface || ' ' || r.surface AS replacement, least(ln(l.freq + r.freq + 2) / 32, 1.0) AS score
FROM words JOIN lex l ON starts_with(word, l.surface) JOIN lex r ON r.surface = substr(word, length(l.surface) + 1) WHERE word NOT IN (SELECT surface FROM lex)"""
_JOIN = """SELECT doc_id, start, word || then_gap || next, word || next, least(ln(freq + 1) / 16, 1.0) FROM words JOIN lex ON surface = word || next WHERE regexp_full_match(then_gap, '\\s+')"""


@query(f"""WITH {KOREAN}, {_LEX}, c AS ({_SPLIT} UNION ALL {_JOIN})
SELECT doc_id, start AS start_cp, original, replacement, round(score, 9) AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start, replacement) <= 32""")
def spacing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words to split, and neighbours to join; the 32 best of a document."""
    found = candidates.spacing_candidates(_words(spark, sf_dir), _lexicon(spark))
    return found.select("doc_id", F.col("start").alias("start_cp"), "original", "replacement", F.round("score", 9).alias("score"))


@query(f"""WITH {KOREAN}, {_LEX}, c AS ({_SPLIT})
SELECT doc_id, start AS start_cp, replacement, round(1 / (1 + exp(-(127 + 6 * ln(f + 1) + 11 * score) * {candidates.RANK_SCALE})), 9) AS rank,
  CASE WHEN 1 / (1 + exp(-(127 + 6 * ln(f + 1) + 11 * score) * {candidates.RANK_SCALE})) >= 0.85 THEN 'high' ELSE 'medium' END AS confidence
FROM (SELECT c.*, exp(score * 32) - 2 AS f FROM c)""")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the linear ranker and their confidence."""
    found = candidates.split_candidates(_words(spark, sf_dir), _lexicon(spark))
    rank = candidates.rank_score(F.col("edits"), F.col("freq"), F.col("score"))
    return found.select("doc_id", F.col("start").alias("start_cp"), "replacement", F.round(rank, 9).alias("rank"), candidates.confidence(rank).alias("confidence"))


@query(f"""WITH {KOREAN}, {_LEX}, c AS ({_SPLIT}), n AS (SELECT c.*, text, length(text) AS a, length(text) + 1 AS b,
  (SELECT max(k) FROM unnest(generate_series(0, length(c.original))) t(k) WHERE left(c.original, k) = left(c.replacement, k)) AS head FROM c JOIN ko USING (doc_id))
SELECT doc_id, start AS start_cp, replacement, round({candidates.CONTEXT_FEATURE_SCALE} * {candidates.CONTEXT_WEIGHT_SCALE} * (
  127 * least(127, greatest(-127, round((1 - (start + head) / b) / {candidates.CONTEXT_FEATURE_SCALE}))) + least(127, greatest(-127, round(ln(b + 1) / {candidates.CONTEXT_FEATURE_SCALE})))
  + 2 * least(127, greatest(-127, round(1 / {candidates.CONTEXT_FEATURE_SCALE})))), 9) AS score FROM n""")
def context_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the context ranker."""
    docs = korean_documents(spark, sf_dir)
    found = candidates.split_candidates(tokens(docs).where("kind = 'word'"), _lexicon(spark)).join(docs.select("doc_id", "text"), "doc_id")
    score = candidates.context_score(F.col("text"), F.col("start"), F.col("original"), F.col("replacement"))
    return found.select("doc_id", F.col("start").alias("start_cp"), "replacement", F.round(score, 9).alias("score"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'abstain' WHEN lang IN ('de', 'fr') THEN 'review' WHEN n_chars % 100 / 99.0 >= 0.99 THEN 'safe' ELSE 'review' END AS policy FROM documents JOIN labels USING (doc_id)""")
def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for labelled documents as candidates: unsafe if toxic, of a risky family by language."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    family = F.when(F.col("lang") == "de", "proper-noun").when(F.col("lang") == "fr", "register").otherwise("spelling")
    score = F.col("n_chars") % 100 / F.lit(99.0)
    return rows.select("doc_id", candidates.policy(family, F.col("toxic") == 0, F.lit("high"), score, F.lit("plain")).alias("policy"))


@query("SELECT vec_id, CAST(greatest(-127, least(127, round_even(CAST(embedding[1] AS DOUBLE) / 0.01, 0))) AS INTEGER) AS first, CAST(greatest(-127, least(127, round(CAST(embedding[2] AS DOUBLE) / 0.01))) AS INTEGER) AS second FROM embeddings")
def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as int8, with both ways to round halves."""
    rows = _read(spark, sf_dir, "embeddings")
    scale = F.lit(0.01)
    value = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return rows.select("vec_id", curate.quantised(value(0), scale).alias("first"), curate.quantised(value(1), scale, half_even=False).alias("second"))


# --- evaluation ------------------------------------------------------------------------------


def _expectations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as expectations, and plain guesses as findings."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    case = F.col("doc_id").cast("string").alias("case_id")
    expected = labels.where("quality = 1").select(case, F.lit("quality").alias("rule_id")).unionByName(labels.where("toxic = 1").select(case, F.lit("toxic").alias("rule_id")))
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    actual = known.where("n_chars > 500").select(case, F.lit("quality").alias("rule_id")).unionByName(known.where("n_chars % 7 = 0").select(case, F.lit("toxic").alias("rule_id")))
    return expected, actual


_COUNTS = """e AS (SELECT doc_id, 'quality' AS rule_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
a AS (SELECT doc_id, 'quality' AS rule_id FROM documents SEMI JOIN labels USING (doc_id) WHERE n_chars > 500 UNION ALL SELECT doc_id, 'toxic' FROM documents SEMI JOIN labels USING (doc_id) WHERE n_chars % 7 = 0),
c AS (SELECT rule_id, CAST(count(*) FILTER (e.doc_id IS NOT NULL AND a.doc_id IS NOT NULL) AS DOUBLE) AS tp, CAST(count(*) FILTER (e.doc_id IS NULL) AS DOUBLE) AS fp, CAST(count(*) FILTER (a.doc_id IS NULL) AS DOUBLE) AS fn
  FROM e FULL JOIN a USING (doc_id, rule_id) GROUP BY rule_id)"""


def _wilson_sql(hits: str, trials: str) -> str:
    z = evaluate.Z
    p = f"({hits} / ({trials}))"
    return f"CASE WHEN ({trials}) > 0 THEN round(greatest(0, ({p} + {z * z} / (2 * ({trials})) - {z} * sqrt(({p} * (1 - {p}) + {z * z} / (4 * ({trials}))) / ({trials}))) / (1 + {z * z} / ({trials}))), 9) END"


@query(f"""WITH {_COUNTS} SELECT rule_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
{_wilson_sql('tp', 'tp + fp')} AS precision_low, {_wilson_sql('tp', 'tp + fn')} AS recall_low FROM c""")
def metrics_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.per_rule(evaluate.matched(*_expectations(spark, sf_dir)))
    return out.select("rule_id", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "precision_low", "recall_low")])


@query(f"""WITH {_COUNTS}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(tp / (tp + fp)) AS mp, avg(tp / (tp + fn)) AS mr FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall,
{_wilson_sql('tp', 'tp + fp')} AS precision_low, {_wilson_sql('tp', 'tp + fn')} AS recall_low FROM s""")
def metrics_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.totals(evaluate.matched(*_expectations(spark, sf_dir)))
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "macro_precision", "macro_recall", "precision_low", "recall_low")])


@query(f"""WITH {_COUNTS}, s AS (SELECT sum(tp) / sum(tp + fp) AS p, sum(tp) / sum(tp + fn) AS r FROM c)
SELECT 'precision' AS metric, round(p, 9) AS value, CAST(0.99 AS DOUBLE) AS least FROM s WHERE p < 0.99 UNION ALL SELECT 'recall', round(r, 9), CAST(0.1 AS DOUBLE) FROM s WHERE r < 0.1""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that the metrics fail."""
    totals = evaluate.totals(evaluate.matched(*_expectations(spark, sf_dir)))
    failed = evaluate.gate_failures(totals, [evaluate.Gate("precision", 0.99), evaluate.Gate("recall", 0.1), evaluate.Gate("precision_low", 1.0, "tp", 10**9)])
    return failed.select("metric", F.round("value", 9).alias("value"), "least")


@query("""WITH n AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0), d AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars % 7 = 0)
SELECT count(*) AS normal, count(*) FILTER (d.doc_id IS NULL) AS clean, round(count(*) FILTER (d.doc_id IS NULL) / count(*), 9) AS specificity FROM n LEFT JOIN d USING (doc_id)""")
def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels")
    cases = labels.select(F.col("doc_id").alias("case_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "normal").otherwise("error").alias("case_type"))
    actual = _read(spark, sf_dir, "documents").where("n_chars % 7 = 0").select(F.col("doc_id").alias("case_id"))
    return evaluate.specificity(cases, actual).select("normal", "clean", F.round("specificity", 9).alias("specificity"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    k = F.pmod(F.col("doc_id"), F.lit(10))
    return docs.select(
        F.col("doc_id").cast("string").alias("case_id"), F.col("lang").alias("genre"), F.when(k < 5, "independent_human").when(k < 7, "revision").when(k < 8, "synthetic").alias("origin"),
        F.when(k < 6, "train").when(k < 8, "dev").otherwise("release_holdout").alias("split"), F.col("source").alias("document_id"), F.when(F.col("n_chars") > 2000, "error").otherwise("normal").alias("case_type"),
        F.filter(F.array(F.when(F.col("n_chars") > 3000, "long"), F.when(k == 3, "three")), lambda x: x.isNotNull()).alias("error_families"),
        F.when(F.col("n_chars") > 2500, F.array(F.lit("r"))).alias("expected_rule_ids"),
    )


_CASES = """k AS (SELECT doc_id, lang AS genre, CASE WHEN doc_id % 10 < 5 THEN 'independent_human' WHEN doc_id % 10 < 7 THEN 'revision' WHEN doc_id % 10 < 8 THEN 'synthetic' END AS origin,
CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'release_holdout' END AS split, source AS document_id, CASE WHEN n_chars > 2000 THEN 'error' ELSE 'normal' END AS case_type, n_chars FROM documents)"""


@query(f"""WITH {_CASES} SELECT count(*) AS cases, count(*) FILTER (coalesce(origin, 'project') <> 'synthetic') AS "natural", count(*) FILTER (origin = 'synthetic') AS synthetic, count(*) FILTER (origin = 'revision') AS human_edits,
count(*) FILTER (origin = 'independent_human') AS independent, count(*) FILTER (case_type = 'normal') AS normal, count(DISTINCT genre) AS genres, count(DISTINCT document_id) AS documents,
count(*) FILTER (split = 'train') AS split_train, count(*) FILTER (split = 'dev') AS split_dev, count(*) FILTER (split = 'release_holdout') AS split_release_holdout FROM k""")
def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dataset_metadata(_cases(spark, sf_dir))


@query(f"""WITH {_CASES}, s AS (SELECT 'genre' AS dimension, genre AS value, case_type FROM k UNION ALL SELECT 'origin', origin, case_type FROM k UNION ALL SELECT 'split', split, case_type FROM k
UNION ALL SELECT 'error_family', 'long', case_type FROM k WHERE n_chars > 3000 UNION ALL SELECT 'error_family', 'three', case_type FROM k WHERE doc_id % 10 = 3)
SELECT dimension, value, count(*) AS cases, count(*) FILTER (case_type = 'error') AS errors, count(*) FILTER (case_type = 'normal') AS normals FROM s WHERE value IS NOT NULL GROUP BY ALL""")
def quality_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quality_slices(_cases(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS case_id, 'error case without expectations' AS problem FROM documents WHERE n_chars > 2000 AND n_chars <= 2500")
def corpus_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.corpus_problems(_cases(spark, sf_dir))


@query("SELECT min(value) AS least, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of event values as samples."""
    out = evaluate.latency(_read(spark, sf_dir, "events").select(F.col("value").alias("ms")), 2**20)
    return out.select("least", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")])


# --- curation --------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda c: F.when(c % 3 == 0, "train").when(c % 3 == 1, "dev").otherwise("release_holdout")
    items = _read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text", split(F.col("item_id")).alias("split"))
    turns = _read(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text", split(F.col("turn")).alias("split"))
    again = turns.where(F.length("text") % 2 == 0).select(F.concat(F.lit("v"), "id").alias("id"), F.concat("text", F.lit(" ok")).alias("text"), F.lit("extra").alias("split"))
    return items.unionByName(turns).unionByName(again)


_RECORDS = """r AS (SELECT 'b' || item_id AS id, text, ['train', 'dev', 'release_holdout'][item_id % 3 + 1] AS split FROM benchmark
UNION ALL SELECT 'c-' || conv_id || '-' || turn, text, ['train', 'dev', 'release_holdout'][turn % 3 + 1] FROM conversations
UNION ALL SELECT 'vc-' || conv_id || '-' || turn, text || ' ok', 'extra' FROM conversations WHERE length(text) % 2 = 0),
n AS (SELECT id, split, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM r)"""


@query("""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, doc_id % 3 AS s FROM documents)
SELECT DISTINCT least(a.doc_id, b.doc_id) AS left_id, greatest(a.doc_id, b.doc_id) AS right_id
FROM d a JOIN (SELECT t, s, min(doc_id) AS doc_id FROM d WHERE t <> '' GROUP BY t, s) b ON a.t = b.t AND a.s <> b.s""")
def leaks_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal normalised texts in different splits: each with the first of every other split."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.pmod(F.col("doc_id"), F.lit(3)).alias("split"))
    return curate.leaks(docs, "exact_text", hangul.normalised(F.col("text"))).select("left_id", "right_id")


def _near_sql(n: int, least: float, more: str, cte: str) -> str:
    return f"""WITH {cte}, g AS (SELECT id, split, list_distinct(CASE WHEN length(t) < {n} THEN [t] ELSE list_transform(generate_series(1, length(t) - {n - 1}), lambda i: substr(t, i, {n})) END) AS g FROM n WHERE t <> ''),
each AS (SELECT id, split, len(g) AS size, unnest(g) AS gram FROM g),
o AS (SELECT a.id AS x, b.id AS y, a.size AS p, b.size AS q, count(*) AS common FROM each a JOIN each b ON a.gram = b.gram AND a.id < b.id {more} GROUP BY ALL)
SELECT x AS left_id, y AS right_id, round(common / (p + q - common), 9) AS score FROM o WHERE common / (p + q - common) >= {least}"""


@query(_near_sql(5, 0.5, "AND a.split <> b.split", _RECORDS))
def leaks_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar texts of benchmark items, conversation turns and turns with two words more, in different splits."""
    return curate.similar_pairs(_records(spark, sf_dir), least=0.5).select("left_id", "right_id", F.round("score", 9).alias("score"))


_GROUPS = _near_sql(5, 0.5, "AND a.split <> b.split", _RECORDS)


@query(f"""WITH RECURSIVE pairs AS ({_GROUPS}), {_RECORDS},
ways AS (SELECT left_id AS a, right_id AS b FROM pairs UNION ALL SELECT right_id, left_id FROM pairs),
reach(a, b) AS (SELECT DISTINCT a, a FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least_of AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a),
counted AS (SELECT a AS id, count(*) AS links FROM ways GROUP BY a),
placed AS (SELECT r.id, r.split, coalesce(group_id, r.id) AS group_id, coalesce(links, 0) AS links FROM r LEFT JOIN least_of USING (id) LEFT JOIN counted USING (id)),
wide AS (SELECT group_id, count(*) AS members, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM placed GROUP BY group_id)
SELECT id, group_id, CAST(links AS BIGINT) AS links, members, splits FROM placed JOIN wide USING (group_id)""")
def leak_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of leaks_near, a row each: the group of similar records in other splits that it belongs to."""
    found = similar_groups(_records(spark, sf_dir), least=0.5)
    return found.select("id", "group_id", F.col("links").cast("long").alias("links"), F.col("members").cast("long").alias("members"), F.array_join("splits", ",").alias("splits"))


@query(_near_sql(3, 0.5, "", "n AS (SELECT conv_id || '-' || turn AS id, 0 AS split, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)"))
def duplicates_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with similar sets of three characters."""
    rows = _read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lit(0).alias("split"))
    return curate.similar_pairs(rows, 3, 0.5, across_splits=False, text=hangul.collapsed(F.col("text"))).select("left_id", "right_id", F.round("score", 9).alias("score"))


@query("SELECT w AS surface, 10 * count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}{2,}')) AS w FROM documents) GROUP BY w")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.word_frequencies(_read(spark, sf_dir, "documents"), r"\p{L}{2,}")


@query("""WITH s AS (SELECT p_name AS surface, p_brand AS pos, p_size AS f FROM part) SELECT surface, min(pos) AS pos, CAST(sum(f) AS BIGINT) AS frequency, count(DISTINCT pos) AS parts FROM s GROUP BY surface""")
def merged_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds with repeated surfaces: summed, with the number of parts of speech each has."""
    from narae.functions.catalogue import merged_seeds

    seeds = _read(spark, sf_dir, "part").select(F.col("p_name").alias("surface"), F.col("p_brand").alias("pos"), F.col("p_size").cast("long").alias("frequency"))
    parts = seeds.groupBy("surface").agg(F.countDistinct("pos").alias("parts"))
    return merged_seeds(seeds).join(parts, "surface")


@query("""SELECT doc_id, CASE WHEN k / n < 0.8 THEN 'train' WHEN k / n < 0.9 THEN 'dev' ELSE 'release_holdout' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)""")
def positional_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.positional_split(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query("""WITH c AS (SELECT d.source AS case_id, d.doc_id, d.n_chars % 2 AS label, CASE WHEN d.source = 'src3' THEN 'release_holdout' ELSE 'train' END AS split FROM documents d JOIN labels USING (doc_id))
SELECT a.case_id, a.doc_id AS chosen, b.doc_id AS rejected FROM c a JOIN c b ON a.case_id = b.case_id WHERE a.label = 1 AND b.label = 0 AND a.split <> 'release_holdout'""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right with wrong candidates of the same case (a source)."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.col("source").alias("case_id"), F.col("doc_id").alias("text"), (F.col("n_chars") % 2).alias("label"), F.when(F.col("source") == "src3", "release_holdout").otherwise("train").alias("split"))
    return curate.training_pairs(rows).select("case_id", "chosen", "rejected")


@query("""SELECT CAST(conv_id AS VARCHAR) AS id, trim(regexp_replace(regexp_replace(string_agg(text, ' ' ORDER BY turn), ' +([.,!?;:)\\]}”’])', '\\1', 'g'), '([(\\[{“‘]) +', '\\1', 'g')) AS text FROM conversations GROUP BY conv_id HAVING count(*) > 4""")
def unchanged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as annotated sentences; those that all annotators left alone (those of more than four turns)."""
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("s"), F.count(F.lit(1)).alias("turns"))
    noop = F.when(F.col("turns") > 4, "A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||1").otherwise("A 0 1|||R:NOUN|||x|||REQUIRED|||-NONE-|||0")
    groups = rows.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("S "), F.replace("s", F.lit("\n"), F.lit(" ")), F.lit("\n"), noop).alias("lines"))
    return curate.unchanged_cases(curate.annotations(groups))


SQL["unchanged_cases"] = SQL["unchanged_cases"].replace("string_agg(text, ' ' ORDER BY turn)", "replace(string_agg(text, ' ' ORDER BY turn), chr(10), ' ')")


# --- files and reports -----------------------------------------------------------------------


@query("""SELECT url, CASE lower(regexp_extract(url, '\\.([^./]+)$', 1)) WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'rs' THEN 'rust' WHEN 'txt' THEN 'plain_text' END AS kind,
replace(url, '/', '|') AS flat FROM pages""")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by extension of page addresses."""
    return _read(spark, sf_dir, "pages").select("url", files.source_kind(F.col("url")).alias("kind"), F.translate("url", "/", "|").alias("flat"))


_LEVEL = "CASE WHEN r.severity = 'info' THEN 'note' ELSE r.severity END"


@query(f"""WITH {KOREAN}, f AS ({_body_sql(BODY)}), r(rule_id, severity) AS (VALUES {_table([(r.id, r.severity) for r in RULES.values()])})
SELECT {_LEVEL} AS level, lang, count(*) AS findings FROM f JOIN r USING (rule_id) JOIN documents USING (doc_id) GROUP BY ALL""")
def sarif_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by report level and language."""
    docs = korean_documents(spark, sf_dir)
    rows = detect.lint(docs, ALL).join(docs.select("doc_id", "lang"), "doc_id")
    return rows.groupBy(files.sarif_level(F.col("severity")).alias("level"), "lang").agg(F.count(F.lit(1)).alias("findings"))


@query("SELECT doc_id, sha256('rules-1' || chr(10) || text) AS key FROM documents WHERE lang <> 'en'")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose results a cache of the English ones lacks."""
    docs = _read(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    cache = docs.where("lang = 'en'").select("path", files.cache_key(F.col("text"), "rules-1").alias("key"))
    return files.cache_split(docs, cache, "rules-1")[1].select("doc_id", "key")


_CATALOGUE = [(r.id, r.category, r.severity, r.profile, r.safety, r.confidence, [p for p in r.incorrect if "가" <= p[0] <= "힣"]) for r in RULES.values()]


@query(f"""WITH {KOREAN}, plain AS (SELECT doc_id, replace(replace(replace(text, 'http://a.kr/몇일', ''), '#몇일', ''), '몇일.txt파일', '') AS text FROM ko),
p(rule_id, pattern) AS (VALUES {_table([(r[0], x) for r in _CATALOGUE for x in r[-1]])}),
n AS (SELECT rule_id, count(DISTINCT doc_id) AS documents FROM p JOIN plain ON contains(text, pattern) GROUP BY rule_id)
SELECT t.*, coalesce(documents, 0) AS documents FROM (VALUES {_table([(*r[:-1], len(r[-1])) for r in _CATALOGUE])}) t(rule_id, category, severity, profile, safety, confidence, patterns) LEFT JOIN n USING (rule_id)""")
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and in how many documents any of a rule's own Korean forms stands, whatever is around it."""
    forms = [(r[0], x) for r in _CATALOGUE for x in r[-1]]
    places = detect.pattern_places(korean_documents(spark, sf_dir), [x for _, x in forms]).select("number", "doc_id")
    named = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(forms)], "number long, rule_id string")
    counts = places.join(F.broadcast(named), "number").groupBy("rule_id").agg(F.countDistinct("doc_id").alias("documents"))
    size = F.size(F.filter("incorrect", lambda p: p.rlike("^[가-힣]"))).alias("patterns")
    rules = rule_table(spark).select("rule_id", "category", "severity", "profile", "safety", "confidence", size)
    return rules.join(counts, "rule_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


@query("""WITH c AS (SELECT conv_id, list(DISTINCT role) FILTER (turn % 2 = 0) AS even, list(DISTINCT role) FILTER (turn % 2 = 1) AS odd FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_sort(list_filter(coalesce(even, []), lambda x: NOT list_contains(coalesce(odd, []), x))), ',') AS missing,
  array_to_string(list_sort(list_filter(coalesce(odd, []), lambda x: NOT list_contains(coalesce(even, []), x))), ',') AS unexpected FROM c""")
def role_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets compared: the roles of a conversation's even turns with those of its odd ones."""
    roles = lambda k: F.collect_set(F.when(F.col("turn") % 2 == k, F.col("role")))
    sets = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles(0).alias("even"), roles(1).alias("odd"))
    both = sets.withColumn("d", evaluate.set_difference(F.col("even"), F.col("odd")))
    return both.select("conv_id", F.array_join(F.array_sort("d.missing"), ",").alias("missing"), F.array_join(F.array_sort("d.unexpected"), ",").alias("unexpected"))


# --- authoring -------------------------------------------------------------------------------

_SEEDS = [(n.rsplit(".", 1)[0], a, b, "high" if f == "safe" else "medium", p) for n, _, p, f, pairs in LITERALS for a, b in pairs]


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed of a part and of one of the bundled pairs in turn."""
    pairs = spark.createDataFrame([(k, *s) for k, s in enumerate(_SEEDS)], "k long, family string, wrong string, right string, confidence string, profile string")
    parts = _read(spark, sf_dir, "part").select("p_partkey", F.pmod(F.col("p_partkey"), F.lit(len(_SEEDS))).alias("k"), "p_name")
    both = parts.join(F.broadcast(pairs), "k")
    return both.select("family", F.concat_ws(" ", "wrong", "p_name").alias("wrong"), F.concat_ws(" ", "right", "p_name", F.col("p_partkey").cast("string")).alias("right"), "confidence", "profile")


def _letters(names, k: str) -> str:
    return "[" + ", ".join("''" if n == "-" else f"'{n}'" for n in names) + f"][CAST({k} AS INTEGER) + 1]"


_SLUG = f"""trim(regexp_replace(array_to_string(list_transform(string_split(good, ''), lambda c: CASE WHEN ord(c) BETWEEN 44032 AND 55203
  THEN {_letters(authoring.INITIALS, 'floor((ord(c) - 44032) / 588)')} || {_letters(authoring.MEDIALS, 'floor((ord(c) - 44032) / 28) % 21')} || {_letters(authoring.FINALS, '(ord(c) - 44032) % 28')}
  ELSE lower(c) END), ''), '[^a-z0-9]+', '-', 'g'), '-')"""


@query(f"""SELECT family || '.' || {_SLUG} AS rule_id, CASE WHEN starts_with(family, 'spelling.') THEN 'error' WHEN starts_with(family, 'style.') OR starts_with(family, 'advanced.') THEN 'info' ELSE 'warning' END AS severity,
confidence, profile, profile = 'default' AS default_enabled, confidence = 'high' AND profile = 'default' AS safe, wrong, good AS "right" FROM (SELECT family, s.wrong || ' ' || p_name AS wrong, s.good || ' ' || p_name || ' ' || p_partkey AS good, confidence, profile
  FROM part JOIN (VALUES {_table([(k, *s) for k, s in enumerate(_SEEDS)])}) s(k, family, wrong, good, confidence, profile) ON p_partkey % {len(_SEEDS)} = k)""")
def seed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows made from seeds of parts, with romanised ids."""
    return authoring.rules_of_seeds(_seeds(spark, sf_dir))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part) SELECT a.t AS wrong, b.t AS other FROM w a JOIN w b ON a.t <> b.t AND contains(a.t, b.t)")
def contained_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names with another in them, as seeds that are not apart."""
    words = _read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("wrong")).where("wrong != ''").distinct()
    return authoring.contained_seeds(words)


@query(f"""WITH {_CASES}, f AS (SELECT count(*) AS n, count(*) FILTER (case_type = 'error') AS e FROM k), t AS (SELECT count(*) - count(DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS d FROM documents)
SELECT 'total' AS problem, 'cases' AS subject, n AS found, 1000000000 AS wanted FROM f UNION ALL SELECT 'total', 'duplicates', d, 3 FROM t WHERE d > 3
UNION ALL SELECT 'genre', 'ko', 0, 5 UNION ALL SELECT 'rule', 'q', 0, 2 UNION ALL SELECT 'profile', 'strict', 0, 1""")
def policy_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents as a corpus lack for a policy."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), "text")
    cases = _cases(spark, sf_dir).join(docs, "case_id").withColumn("source_kind", F.lit("plain_text")).withColumn("profile", F.lit("default"))
    wanted = authoring.Policy(least_cases=10**9, most_duplicates=3, genres=("en", "ko"), least_per_genre=5, source_kinds=("plain_text",), rule_minimums=(("r", 1), ("q", 2)), profile_minimums=(("strict", 1),))
    return authoring.policy_problems(cases, wanted)


@query(f"""WITH {KOREAN} SELECT doc_id, start AS start_cp, word AS original, good AS replacement, 1.0::DOUBLE AS score, CASE WHEN word = good THEN 0.0 ELSE 0.5 END::DOUBLE AS plain
FROM words JOIN (VALUES {_table([(n, a, b) for n, a, b, _ in _LITERALS])}) r(rule_id, wrong, good) ON word = wrong""")
def exact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words that a literal rule lists."""
    rules = literal_table(spark).select("rule_id", "wrong", "right")
    found = candidates.exact_candidates(_words(spark, sf_dir), rules)
    return found.select("doc_id", F.col("start").alias("start_cp"), "original", "replacement", "score", candidates.plain_score(F.col("original"), F.col("replacement")).alias("plain"))


@query(f"""WITH {KOREAN}, f AS ({_body_sql(BODY)}), r(rule_id, safety) AS (VALUES {_table([(r.id, r.safety) for r in RULES.values()])})
SELECT safety, CASE safety WHEN 'safe' THEN 'high' ELSE 'medium' END AS confidence, CASE safety WHEN 'safe' THEN 1.0 ELSE 0.5 END::DOUBLE AS score, count(*) AS findings FROM f JOIN r USING (rule_id) GROUP BY safety""")
def findings_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the nested form, by what their suggestions say."""
    rows = candidates.with_evidence(detect.lint(korean_documents(spark, sf_dir), ALL)).withColumn("s", F.explode("suggestions"))
    return rows.groupBy("s.safety", "s.confidence", F.get("s.evidence", F.lit(0))["score"].alias("score")).agg(F.count(F.lit(1)).alias("findings"))
