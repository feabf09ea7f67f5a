"""Tokens of the prose in documents: Hangul words and punctuation, with what rules look at around them.

One pass over each text turns documents into a token table; all rules are joins and column
expressions over that table, without another look at the texts. Documents that no rule can concern
are left out before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narae.session import rows_of, small_batches, spread, tidy
from narae.sources.ranges import WHITE, prose_ranges

#: Characters after a word that literal patterns may look at.
AHEAD = 24

_MARKS = re.compile(r"(?P<word>[가-힣]+)|(?P<comma>,,+|,(?=[가-힣]))|(?<=[ \t])(?P<blank>[.!?])|(?P<mark>[.!?])(?=[가-힣])")
_FIRST, _LAST = "가", "힣"
_FIELDS = [
    ("doc_id", pa.int64()), ("range_no", pa.int32()), ("token_no", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("byte_start", pa.int64()), ("surface", pa.string()),
    ("lead", pa.string()), ("before", pa.string()), ("ahead", pa.string()), ("after", pa.string()), ("previous", pa.string()), ("next", pa.string()), ("repeats", pa.int32()), ("gap", pa.string()),
]
SCHEMA = "doc_id long, range_no int, token_no int, kind string, start long, byte_start long, surface string, lead string, before string, ahead string, after string, previous string, next string, repeats int, gap string"


def tokens_of(text: str, kind: str) -> list[tuple]:
    """Rows of one text, without its id.

    kind: word, comma (a run of several, or one before Hangul), blank (a run before a mark) or mark (before Hangul). lead: Hangul right
    before the range that the word continues; before: the character before, ahead: the text that
    follows, both within the range; after: the character that follows in the whole text. previous and
    next: the neighbouring words, where only white space lies between; repeats: how many equal words
    precede in an unbroken row; gap: all of the white space after a word, within the range and of any length.
    """
    out = []
    size = at = 0
    for number, (begin, end) in enumerate(prose_ranges(text, kind)):
        found = list(_spans(text, begin, end))
        words = [(a, b) for a, b, name in found if name == "word"]
        near = [not text[a[1] : b[0]].strip(_STRIP) for a, b in zip(words, words[1:])]
        turn, repeats = 0, 0
        for start, stop, name in found:
            size += len(text[at:start].encode())
            at = start
            before = text[start - 1] if start > begin else ""
            lead = previous = following = gap = ""
            own = text[start:stop]
            if name == "word":
                if start == begin and begin:
                    first = begin
                    while first and _FIRST <= text[first - 1] <= _LAST:
                        first -= 1
                    lead = text[first:begin]
                if turn and near[turn - 1]:
                    previous = text[slice(*words[turn - 1])]
                if turn < len(near) and near[turn]:
                    following = text[slice(*words[turn + 1])]
                gap = _GAP.match(text, stop, end).group()
                repeats = repeats + 1 if previous == own else 0
                turn += 1
            out.append((number, len(out), name, start, size, own, lead, before, text[stop : min(end, stop + AHEAD)], text[stop : stop + 1], previous, following, repeats, gap))
    return out


def _spans(text: str, begin: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Begin, end and kind of the tokens of a range. Blanks are told by the mark behind them."""
    for m in _MARKS.finditer(text, begin, end):
        start, stop = m.span()
        if m.lastgroup == "blank":
            first = start
            while first > begin and text[first - 1] in " \t":
                first -= 1
            if first < start:
                yield first, start, "blank"
            if not (stop < end and _FIRST <= text[stop] <= _LAST):
                continue
        yield start, stop, m.lastgroup if m.lastgroup != "blank" else "mark"


_STRIP = WHITE.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))
_GAP = re.compile(f"[{re.escape(_STRIP)}]*")


def tokens(docs: DataFrame) -> DataFrame:
    """The token table of (doc_id, text[, source_kind]) rows. A null text has no tokens."""
    kind = F.col("source_kind") if "source_kind" in docs.columns else F.lit("plain_text")
    small_batches(docs.sparkSession)
    # Nothing but Hangul, doubled commas and blanks before marks can meet a rule.
    wanted = docs.where(F.col("text").rlike("[가-힣]|,,|[ \\t][.!?]"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ident, text, form in rows_of(batch):
                out += [(ident, *row) for row in tokens_of(text, form)]
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return spread(wanted.select(F.col("doc_id").cast("long"), "text", kind.alias("source_kind"))).mapInArrow(tidy(rows), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])


RANGES = "doc_id long, range_no int, start long, end long, byte_start long, byte_end long"


def range_table(docs: DataFrame) -> DataFrame:
    """(doc_id, range_no, start, end, byte_start, byte_end) of the linted ranges of each document."""
    kind = F.col("source_kind") if "source_kind" in docs.columns else F.lit("plain_text")
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, text, form in rows_of(batch):
                size = at = 0
                for number, (a, b) in enumerate(prose_ranges(text, form)):
                    size += len(text[at:a].encode())
                    wide = len(text[a:b].encode())
                    out.append((ident, number, a, b, size, size + wide))
                    size, at = size + wide, b
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in RANGES.split(", ")])

    return spread(docs.where("text is not null").select(F.col("doc_id").cast("long"), "text", kind.alias("source_kind"))).mapInArrow(tidy(rows), RANGES)
