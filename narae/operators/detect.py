"""Detectors: the token table in, one row a finding out.

A detector lists rules over the columns of a token, or over the characters of a word; all rules together are
one projection, so that linting reads the token table once for tokens and once for characters. None looks at
the text, and none shuffles. Findings carry code point and UTF-8 byte ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narae.functions import automaton
from narae.functions.catalogue import PROFILES, RULES, Config, PackRule, enabled, is_dictionary_rule, literal_table
from narae.functions.hangul import BIEUP, NIEUN, RIEUL, final, is_syllable, with_final
from narae.session import materialise, rows_of, small_batches, spread, tidy
from narae.sources.ranges import prose_ranges
from narae.sources.tokens import tokens

#: Patterns, entries or words up to which a table of them is broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000
COLUMNS = ["doc_id", "start", "end", "byte_start", "byte_end", "original", "suggestion", "rule_id", "severity", "safe", "turn"]

# Forms, suffixes, nouns and particles that the rules name.
DOE_FORMS = [("되서", "돼서"), ("되요", "돼요"), ("되야", "돼야"), ("됀", "된"), ("됄", "될"), ("됌", "됨")]
DWAE_SUFFIXES = ["게", "게요", "면", "고", "는", "겠", "면서", "도록"]
EURYEO_FORMS = [("할려고", "하려고"), ("할려면", "하려면"), ("먹을려고", "먹으려고"), ("먹을려면", "먹으려면"), ("읽을려고", "읽으려고"), ("읽을려면", "읽으려면"), ("잡을려고", "잡으려고"), ("잡을려면", "잡으려면")]
EURYEO_CONTEXT = [("갈려고", "가려고"), ("갈려면", "가려면")]
ANH_DOE = "^않(되|돼|된|될|됨|됩|됐)"
DEPENDENT_NOUNS = [("de", "데"), ("chae", "채"), ("deut", "듯"), ("mankeum", "만큼"), ("daero", "대로"), ("beop", "법"), ("ri", "리")]
SUBJECT_NOUNS = ["나무", "사과", "바다", "학교", "의자", "모자", "친구", "연필", "동생"]
PARTICLE_NOUNS = (
    "책 연필 사과 친구 동생 의자 학교 나무 문서 파일 값 글 댓글 사용자 프로젝트 코드 자료 결과 정보 문장 문제 시간 회의 방법 이유 작업 계획 서비스 제품 기능 화면 규칙 단어 문법 검사기"
).split()
PARTICLE_STOPS = ",.!?…:;)]}”’"
#: (rule, wrong, right) after a final consonant (that of ㄹ aside for the last), and after a vowel.
AFTER_FINAL = [("topic", "는", "은"), ("object", "를", "을"), ("comitative", "와", "과"), ("instrumental", "로", "으로")]
AFTER_VOWEL = [("topic", "은", "는"), ("object", "을", "를"), ("comitative", "과", "와"), ("instrumental", "으로", "로")]


@dataclass(frozen=True)
class Rule:
    """A finding wherever ``when`` holds: on a token, or on a character of a word (``offset``)."""

    when: Column
    offset: Column
    original: Column
    suggestion: Column
    turn: int
    name: Column
    severity: Column
    safe: Column


def _word() -> Column:
    return F.col("kind") == "word"


def _rule(name: str, when: Column, offset: Column, original: Column, suggestion: Column, turn: int) -> Rule:
    rule = RULES[name]
    return Rule(when, offset, original, suggestion, turn, F.lit(name), F.lit(rule.severity), F.lit(rule.safety == "safe"))


def _allowed(name: str, config: Config) -> bool:
    return name not in config.disabled and PROFILES[RULES[name].profile] <= config.level


def _findings(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """All findings of the rules, in one pass over the rows."""
    kind = "struct<offset:int,original:string,suggestion:string,rule_id:string,severity:string,safe:boolean,turn:int>"
    each = [
        F.when(r.when, F.struct(r.offset.cast("int"), r.original, r.suggestion, r.name, r.severity, r.safe, F.lit(r.turn)).cast(kind))
        for r in rules
    ]
    found = rows.select("doc_id", "kind", "start", "byte_start", F.explode(F.array(*each) if each else F.array().cast(f"array<{kind}>")).alias("f")).where("f is not null")
    return _placed(found.select("doc_id", "kind", "start", "byte_start", "f.*"))


def _placed(found: DataFrame) -> DataFrame:
    """Findings at an offset into their token. Offsets into words are three bytes a character."""
    start = F.col("start") + F.col("offset")
    byte_start = F.col("byte_start") + F.when(_word(), F.col("offset") * 3).otherwise(F.col("offset"))
    return found.select(
        "doc_id", start.alias("start"), (start + F.char_length("original")).cast("long").alias("end"), byte_start.alias("byte_start"),
        (byte_start + F.octet_length("original")).alias("byte_end"), "original", "suggestion", "rule_id", "severity", "safe", "turn",
    )


def _whole(name: str, when: Column, suggestion: Column, turn: int, config: Config) -> list[Rule]:
    """A finding on each whole word for which ``when`` holds."""
    return [_rule(name, _word() & when, F.lit(0), F.col("surface"), suggestion, turn)] if _allowed(name, config) else []


def _places(found: DataFrame, firsts: set[str]) -> DataFrame:
    """The words that have one of the characters, a row for each of their places; rest: the word from there on."""
    words = found.where(_word() & F.col("surface").rlike(f"[{''.join(sorted(firsts))}]"))
    places = words.withColumn("offset", F.explode(F.sequence(F.lit(0), F.char_length("surface") - 1)))
    return places.withColumn("rest", F.expr("substring(surface, offset + 1)"))


def literals(found: DataFrame, config: Config) -> DataFrame:
    """Bundled literal rules and literal forms, by the first character of the pattern.

    Patterns may go on after their word. A prefix pattern needs a word begin that no letter, digit
    or underscore of the range touches.
    """
    table = enabled(literal_table(found.sparkSession), config)  # some 120 rows
    firsts = {r[0] for r in table.select("first").distinct().collect()}
    if not firsts:
        return _findings(found, [])
    places = _places(found, firsts).drop("turn").withColumn("first", F.substring("rest", 1, 1)).where(F.col("first").isin(sorted(firsts)))
    free = ~F.col("before").rlike("[\\p{IsAlphabetic}\\p{N}_]")
    place = (F.col("boundary") == "substring") | (F.col("offset") == 0) & free
    joined = places.join(F.broadcast(table), "first").where(place & F.concat("rest", "ahead").startswith(F.col("wrong")))
    turn = F.when(F.col("rule_id").isin([r[0] for r in _forms()]), 2).otherwise(0)
    return _placed(joined.select("doc_id", "kind", "start", "byte_start", "offset", F.col("wrong").alias("original"), F.col("right").alias("suggestion"), "rule_id", "severity", "safe", turn.alias("turn")))


def _forms() -> list[tuple]:
    from narae.functions.rule_tables import FORMS

    return FORMS


def doubled_particles(config: Config) -> list[Rule]:
    """A particle twice at the end of a word that begins before: of a longer run its last pair, if runs pair up so."""
    name = "grammar.particle.duplicate"
    if not _allowed(name, config):
        return []
    run, size = F.char_length(F.regexp_extract("surface", "(를+|을+|은+|는+)$", 1)), F.char_length("surface")
    twice = F.col("surface").rlike("(를를|을을|은은|는는)$") & (run % 2 == 0) & (size > 2)
    return [_rule(name, _word() & twice, size - 2, F.substring("surface", -2, 2), F.substring("surface", -1, 1), 2)]


def doe_to_dwae(config: Config) -> list[Rule]:
    """Forms of 되다 that need 돼 and the other way round, anywhere in a word (rules over its characters); the
    form 되도 as a whole word."""
    name = "grammar.conjugation.doe-to-dwae"
    if not _allowed(name, config):
        return []
    out = [_rule(name, F.col("rest").startswith(a), F.col("offset"), F.lit(a), F.lit(b), 3) for a, b in DOE_FORMS]
    return [*out, _rule(name, (F.col("surface") == "되도") & (F.col("offset") == 0), F.lit(0), F.col("surface"), F.lit("돼도"), 3)]


def dwae_to_doe(config: Config) -> list[Rule]:
    pattern = f"돼({'|'.join(DWAE_SUFFIXES)})$"
    return _whole("grammar.conjugation.dwae-to-doe", F.col("surface").rlike(pattern), F.regexp_replace("surface", pattern, "되$1"), 4, config)


def _first_form(name: str, forms: list[tuple[str, str]], turn: int, config: Config) -> list[Rule]:
    """Whole words with the first of the forms replaced, the longest of those at the same place."""
    places = F.array(*[F.struct(F.locate(a, F.col("surface")).alias("at"), F.lit(-len(a)).alias("size"), F.lit(a).alias("wrong"), F.lit(b).alias("right")) for a, b in forms])
    first = F.array_min(F.filter(places, lambda p: p["at"] > 0))
    fixed = F.concat(F.substring(F.col("surface"), F.lit(1), first["at"] - 1), first["right"], F.substring(F.col("surface"), first["at"] - first["size"], F.lit(2**30)))
    return _whole(name, F.col("surface").rlike("|".join(a for a, _ in forms)), fixed, turn, config)


def euryeo(config: Config) -> list[Rule]:
    return _first_form("grammar.ending.euryeo", EURYEO_FORMS, 5, config)


def euryeo_context(config: Config) -> list[Rule]:
    return _first_form("grammar.ending.euryeo-context", EURYEO_CONTEXT, 6, config)


def colloquial_yong(config: Config) -> list[Rule]:
    return _whole("grammar.ending.colloquial-yong", F.col("surface").rlike("(해|세)용$"), F.regexp_replace("surface", "용$", "요"), 7, config)


def seumnida(config: Config) -> list[Rule]:
    """-읍니다 and -읍니까: the stem takes ㅂ after a vowel or ㄹ, else 습."""
    stem = F.regexp_extract("surface", "^(.+)읍니[다까]$", 1)
    last, tail = F.substring(stem, -1, 1), F.substring("surface", -2, 2)
    open_ = final(last).isin(0, RIEUL)
    changed = F.concat(F.expr("substring(surface, 1, char_length(surface) - 4)"), with_final(last, BIEUP), tail)
    return _whole("grammar.ending.seumnida", F.col("surface").rlike("^.+읍니[다까]$"), F.when(open_, changed).otherwise(F.concat(stem, F.lit("습"), tail)), 8, config)


def sipsio(config: Config) -> list[Rule]:
    return _whole("grammar.ending.sipsio", F.col("surface").endswith("십시요"), F.regexp_replace("surface", "요$", "오"), 8, config)


def anieyo(config: Config) -> list[Rule]:
    return _whole("grammar.copula.anieyo", F.col("surface") == "아니예요", F.lit("아니에요"), 8, config)


def anh_doe(config: Config) -> list[Rule]:
    when = F.col("surface").rlike(ANH_DOE) & (F.col("surface") != "않되")
    return _whole("grammar.negation.anh-doe", when, F.regexp_replace("surface", "^않", "안 "), 8, config)


def dependent_nouns(config: Config) -> list[Rule]:
    """Dependent nouns written onto the word before: by the last place of the noun in the word."""
    out = []
    for key, noun in DEPENDENT_NOUNS:
        pattern = f"^(.+){noun}(.*)$"
        stem, rest = F.regexp_extract("surface", pattern, 1), F.regexp_extract("surface", pattern, 2)
        last = F.substring(stem, -1, 1)
        adnominal = last.isin("은", "는", "을")
        holds = {
            "de": lambda: (stem != "쓸") & (final(last) == RIEUL) & rest.rlike("^(가|를|도|는|에|까지|마다)"),
            "chae": lambda: (stem != "산") & (final(last) == NIEUN) & rest.startswith("로"),
            "deut": lambda: ~stem.rlike("(그럴|번|반)$") & (adnominal | final(last).isin(NIEUN, RIEUL)) & rest.rlike("^[하싶이]"),
            "mankeum": lambda: ~stem.isin("마을", "가을", "노을", "은") & adnominal,
            "daero": lambda: ~stem.isin("마을", "가을", "노을") & adnominal,
            "beop": lambda: stem.endswith("는") & rest.rlike("^[이입도]"),
            "ri": lambda: ~stem.isin("물", "멀", "빨", "랠", "칼") & (final(last) == RIEUL) & rest.rlike("^[가는도]") & (F.col("gap") != "") & F.col("next").startswith("없"),
        }[key]()
        out += _whole(f"spacing.dependent-noun.{key}", F.col("surface").contains(noun) & (stem != "") & holds, F.concat(stem, F.lit(f" {noun}"), rest), 8, config)
    return out


def deun_choice(config: Config) -> list[Rule]:
    """던지 at the end of a word and in the next: both. The middle one of three is found twice."""
    name = "grammar.ending.deun-choice"
    if not _allowed(name, config):
        return []
    first = F.col("surface").endswith("던지") & F.col("next").contains("던지")
    second = F.col("surface").contains("던지") & F.col("previous").endswith("던지")
    part = F.substring(F.col("surface"), F.lit(1), F.locate("던지", F.col("surface")) + 1)
    fixed = lambda c: F.concat(F.substring(c, F.lit(1), F.char_length(c) - 2), F.lit("든지"))
    return [_rule(name, _word() & first, F.lit(0), F.col("surface"), fixed(F.col("surface")), 9), _rule(name, _word() & second, F.lit(0), part, fixed(part), 9)]


def particles(config: Config) -> list[Rule]:
    """Particles that do not fit the final of the noun before; only in the strict profile. Rules over characters.

    After a final the forms are found anywhere in a word; after a vowel (and 이 for 가) only behind a
    listed noun, at a word's end. The noun is the Hangul before, also from before the range.
    """
    if config.level < PROFILES["strict"]:
        return []
    noun = F.concat(F.col("lead"), F.substring(F.col("surface"), F.lit(1), F.col("offset")))
    last, rest = F.substring(noun, -1, 1), F.col("rest")
    ends = (F.col("after") == "") | F.col("after").rlike(f"(?U)[\\s{''.join(chr(92) + c for c in PARTICLE_STOPS)}]")
    listed = noun.isin(PARTICLE_NOUNS)
    out = []

    def one(name: str, wrong: str, right: str, holds: Column, turn: int) -> None:
        name = f"grammar.particle.{name}-allomorph"
        if _allowed(name, config):
            when = rest.startswith(wrong) & (noun != "") & holds
            out.append(_rule(name, when, -F.char_length("lead"), F.concat(noun, F.lit(wrong)), F.concat(noun, F.lit(right)), turn))

    for k, (name, wrong, right) in enumerate(AFTER_FINAL):
        closed = (final(last) > 0) & (last != wrong)
        closed &= (final(last) != RIEUL) if name == "instrumental" else F.lit(True)
        one(name, wrong, right, closed & (listed if name == "topic" else F.lit(True)), 10 + k)
    for k, (name, wrong, right) in enumerate(AFTER_VOWEL):
        one(name, wrong, right, listed & (final(last) == 0) & (rest == wrong) & ends, 14 + k)
    one("subject", "이", "가", noun.isin(SUBJECT_NOUNS) & (final(last) == 0) & (rest == "이") & ends, 18)
    return out


def commas(config: Config) -> list[Rule]:
    """Runs of commas, and a comma right before Hangul (the last of a run where doubled ones are allowed)."""
    twice, space = "punctuation.duplicate.comma", "punctuation.space-after-comma"
    comma, size = F.col("kind") == "comma", F.char_length("surface")
    hangul = is_syllable(F.substring("ahead", 1, 1)) & (F.col("ahead") != "")
    spaced, doubled = space not in config.disabled, twice not in config.disabled
    out = []
    if doubled:
        right = F.when(hangul, F.lit(", ")).otherwise(F.lit(",")) if spaced else F.lit(",")
        out.append(Rule(comma & (size > 1), F.lit(0), F.col("surface"), right, 19, F.lit(twice), F.lit("warning"), F.lit(True)))
    if spaced:
        out.append(_rule(space, comma & hangul & (size == 1 if doubled else F.lit(True)), size - 1, F.lit(","), F.lit(", "), 19))
    return out


def sentence_marks(config: Config) -> list[Rule]:
    """A sentence mark right before Hangul, unless a digit stands before it."""
    name = "punctuation.space-after-sentence-mark"
    if name in config.disabled:
        return []
    return [_rule(name, (F.col("kind") == "mark") & ~F.col("before").rlike("^[0-9]$"), F.lit(0), F.col("surface"), F.concat("surface", F.lit(" ")), 19)]


def blanks_before_marks(config: Config) -> list[Rule]:
    name = "punctuation.no-space-before-mark"
    return [] if name in config.disabled else [_rule(name, F.col("kind") == "blank", F.lit(0), F.col("surface"), F.lit(""), 19)]


def repeated_words(config: Config) -> list[Rule]:
    """A word and the same word after white space; each word takes part in one finding at most."""
    name = "repetition.adjacent-word"
    if name in config.disabled:
        return []
    when = _word() & (F.col("next") == F.col("surface")) & (F.col("repeats") % 2 == 0) & (F.col("surface") != "그때")
    return [_rule(name, when, F.lit(0), F.concat("surface", "gap", "surface"), F.col("surface"), 20)]


#: Rules over tokens, and rules over the characters of words with the characters that they start with.
OF_TOKENS = {
    "doubled_particles": doubled_particles, "dwae_to_doe": dwae_to_doe, "euryeo": euryeo, "euryeo_context": euryeo_context, "colloquial_yong": colloquial_yong, "seumnida": seumnida, "sipsio": sipsio,
    "anieyo": anieyo, "anh_doe": anh_doe, "dependent_nouns": dependent_nouns, "deun_choice": deun_choice, "commas": commas, "sentence_marks": sentence_marks, "blanks_before_marks": blanks_before_marks,
    "repeated_words": repeated_words,
}
OF_PLACES = {
    "doe_to_dwae": (doe_to_dwae, {a[0] for a, _ in DOE_FORMS}), "particles": (particles, {wrong[0] for _, wrong, _ in AFTER_FINAL + AFTER_VOWEL} | {"이"}),
}


def _token_findings(found: DataFrame, names, config: Config) -> DataFrame:
    return _findings(found, [rule for n in names for rule in OF_TOKENS[n](config)])


def _place_findings(found: DataFrame, names, config: Config) -> DataFrame:
    rules, firsts = [], set()
    for n in names:
        make, own = OF_PLACES[n]
        some = make(config)
        rules += some
        firsts |= own if some else set()
    if not rules:
        return _findings(found, [])
    places = _places(found, firsts).where(F.substring("rest", 1, 1).isin(sorted(firsts)))
    return _findings(places, rules)


#: Each detector alone, over a token table.
DETECTORS = {
    "literals": literals, **{n: lambda found, config, n=n: _token_findings(found, [n], config) for n in OF_TOKENS}, **{n: lambda found, config, n=n: _place_findings(found, [n], config) for n in OF_PLACES},
}


def without_known_words(findings: DataFrame, config: Config) -> DataFrame:
    """Leaves out findings of the lexical rules on words that a dictionary or overlay lists."""
    known = sorted(config.known_words)
    if not known:
        return findings
    listed = findings.sparkSession.createDataFrame([(w,) for w in known], "original string")
    lexical = is_dictionary_rule(F.col("rule_id"))
    listed = F.broadcast(listed) if len(known) <= MOST_BROADCAST else listed
    return findings.where(~lexical).unionByName(findings.where(lexical).join(listed, "original", "left_anti").select(*COLUMNS))


def lint(docs: DataFrame, config: Config = Config(), packs: list[PackRule] | None = None) -> DataFrame:
    """All findings in (doc_id, text[, source_kind]) rows. Order them by start, end, rule_id, turn.

    Tokens are made once and written to the shared folder; rules over tokens, rules over the characters of
    words and literal forms each read it once.
    """
    found = materialise(tokens(docs), "tokens")
    every = _token_findings(found, OF_TOKENS, config).unionByName(_place_findings(found, OF_PLACES, config)).unionByName(literals(found, config)).select(*COLUMNS)
    if packs:
        every = every.unionByName(pack_findings(docs, packs, config).select(*COLUMNS))
    return without_known_words(every, config)


#: Characters of text that the automata of a pack run over at once (a longer text is taken alone).
_AT_ONCE = 2 << 20


def pattern_places(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(doc_id, number, start, byte_start, before, after) of each place of each pattern in the linted ranges.

    number: the pattern's in the list; before and after: the characters around the place, within its range. Places
    of one pattern in one range do not overlap, the first one counts. All patterns are found in one pass over a
    text for each block of them; the blocks' tables, of bounded size each, go to the workers once.
    """
    small_batches(docs.sparkSession)
    automata = docs.sparkSession.sparkContext.broadcast(automaton.blocks(patterns))
    sizes = np.array([len(p) for p in patterns], np.int64)
    kind = F.col("source_kind") if "source_kind" in docs.columns else F.lit("plain_text")
    source = spread(docs.where("text is not null").select("doc_id", "text", kind.alias("_kind")))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, number long, start long, byte_start long, before string, after string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds, begin, held = [], [], 0, 0
            for k, (_, text, kind) in enumerate(rows_of(batch)):
                texts.append(text)
                kinds.append(kind)
                held += len(text)
                if held >= _AT_ONCE or k + 1 == batch.num_rows:
                    yield _places_of(texts, kinds, batch.column(0).slice(begin, k + 1 - begin), automata.value, sizes)
                    texts, kinds, begin, held = [], [], k + 1, 0

    return source.mapInArrow(tidy(rows), schema)


def _places_of(texts: list[str], kinds: list[str], idents: pa.Array, automata: list, sizes: np.ndarray) -> pa.RecordBatch:
    spans = [(k, a, b) for k, (text, kind) in enumerate(zip(texts, kinds)) for a, b in prose_ranges(text, kind)]
    codes = [automaton.code_points(t) for t in texts]
    # All ranges in one row, a gap before each and at the end; where each range begins there, and in its text.
    gap = np.array([automaton.GAP], np.uint32)
    row = np.concatenate([x for k, a, b in spans for x in (gap, codes[k][a:b])] + [gap])
    text_of, first, size = (np.array(x, np.int64) for x in (zip(*[(k, a, b - a) for k, a, b in spans]) if spans else ([], [], [])))
    at = np.cumsum(size + 1) - size
    found = [machine.places(row) for machine in automata]
    ends, numbers = (np.concatenate(x) for x in zip(*found))
    starts = ends - sizes[numbers]
    span = np.searchsorted(at, starts, side="right") - 1
    order = np.lexsort((starts, numbers, span))
    starts, numbers, span = starts[order], numbers[order], span[order]
    keep = automaton.apart(starts, sizes[numbers], span * len(sizes) + numbers)
    starts, numbers, span = starts[keep], numbers[keep], span[keep]
    place, text = starts - at[span] + first[span], text_of[span]
    # Bytes before each place, by the widths of the characters before it in its text.
    bytes_at = np.zeros(len(starts), np.int64)
    for k in np.unique(text).tolist():
        c = codes[k]
        widths = np.cumsum(1 + (c > 0x7F).astype(np.int8) + (c > 0x7FF) + (c > 0xFFFF), dtype=np.int64)
        mine = text == k
        bytes_at[mine] = np.concatenate([[0], widths])[place[mine]]
    shown = lambda c: pa.array(["" if x == automaton.GAP else chr(x) for x in c.tolist()], pa.string())
    return pa.RecordBatch.from_arrays(
        [idents.take(pa.array(text)), pa.array(numbers), pa.array(place), pa.array(bytes_at), shown(row[starts - 1]), shown(row[starts + sizes[numbers]])],
        names=["doc_id", "number", "start", "byte_start", "before", "after"],
    )


def pack_findings(docs: DataFrame, packs: list[PackRule], config: Config = Config()) -> DataFrame:
    """Findings of rule packs: every pattern's places from left to right that do not overlap, in plain
    text ranges, of which those that meet their boundary are reported."""
    spark: SparkSession = docs.sparkSession
    rows = [
        (r.id, r.severity, r.safe_fix, p.wrong, p.right, p.boundary) for r in packs for p in r.patterns if PROFILES[r.profile] <= config.level and r.id not in config.disabled
    ]
    rules = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "number long, rule_id string, severity string, safe boolean, wrong string, right string, boundary string")
    places = pattern_places(docs, [r[3] for r in rows]) if rows else docs.select("doc_id").where("false").select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (("number", "long"), ("start", "long"), ("byte_start", "long"), ("before", "string"), ("after", "string"))])
    found = places.join(F.broadcast(rules) if len(rows) <= MOST_BROADCAST else rules, "number")
    letter = "[\\p{IsAlphabetic}\\p{N}_]"
    left = ~F.substring("wrong", 1, 1).rlike(letter) | ~F.col("before").rlike(letter)
    right = ~F.substring("wrong", -1, 1).rlike(letter) | ~F.col("after").rlike(letter)
    holds = F.when(F.col("boundary") == "word", left & right).when(F.col("boundary") == "prefix", left).when(F.col("boundary") == "suffix", right).otherwise(True)
    return found.where(holds).select(
        "doc_id", "start", (F.col("start") + F.char_length("wrong")).alias("end"), "byte_start", (F.col("byte_start") + F.octet_length("wrong")).alias("byte_end"),
        F.col("wrong").alias("original"), F.col("right").alias("suggestion"), "rule_id", "severity", "safe", F.lit(1).alias("turn"),
    )
