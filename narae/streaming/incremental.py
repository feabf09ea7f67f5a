"""Incremental lint of edited documents: what edits touch is linted anew, and findings go out as changes.

A stateful operator keeps each document by uri as a list of lines with lasting ids. Edits (by UTF-16 positions, by
UTF-8 bytes, or of the whole text) are made in the order of their versions. For each batch it emits windows of
lines: as they were, with sign -1, and as they are, with sign 1. The batch lint finds the findings of both, and those that
begin in the window's own lines are withdrawn or added, placed by line id and column. So a line that only moved
costs nothing, and the sum of all changes is a lint of the documents as they stand.

A finding looks at its line and at the nearest words before and after, and repeated words count from the first of their
row. Therefore a window's own lines reach up and down to a line with two different tokens, and it has as much again
around them to look at. Only plain text is cut so; of other kinds of sources the window is the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from narae.functions.catalogue import Config
from narae.operators.detect import lint
from narae.session import materialise

#: An edit: of a range of lines and UTF-16 positions, of a range of bytes, or (both null) of the whole text; or the
#: document's closing.
EDITS = "uri string, version long, source_kind string, start_line int, start_character int, end_line int, end_character int, start_byte long, end_byte long, text string, closed boolean"
WINDOWS = "uri string, version long, source_kind string, sign int, text string, ids array<long>, starts array<int>, first int, last int"
CHANGES = ["uri", "version", "sign", "line_id", "column", "original", "suggestion", "rule_id", "severity", "safe", "turn"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds after which a closed document's text is forgotten.
FORGET_AFTER = 600_000


def position(line: str, character: int) -> int:
    """Code points before a UTF-16 position in a line; beyond its end, its end."""
    row = line.rstrip("\r")
    if row.isascii():
        return min(character, len(row))
    at = units = 0
    while at < len(row) and units < character:
        units += 2 if ord(row[at]) > 0xFFFF else 1
        at += 1
    return at


def byte_position(lines: list[str], offset: int) -> tuple[int, int]:
    """Line and code point of a byte offset; ValueError beyond the text or within a character."""
    for k, line in enumerate(lines):
        data = line.encode()
        if offset <= len(data):
            try:
                return k, len(data[:offset].decode())
            except UnicodeDecodeError:
                raise ValueError("an edit cuts a character") from None
        offset -= len(data) + 1
    raise ValueError("an edit goes beyond the text")


def replaced(lines: list[str], edit: Row) -> tuple[int, int, list[str]]:
    """(begin, end, new): the edit as lines that take the place of a range of lines."""
    text = edit.text or ""
    if edit.start_byte is not None:
        (a, x), (b, y) = byte_position(lines, edit.start_byte), byte_position(lines, edit.end_byte)
    elif edit.start_line is not None:
        a, b = min(edit.start_line, len(lines) - 1), min(edit.end_line, len(lines) - 1)
        x = position(lines[a], edit.start_character) if edit.start_line < len(lines) else len(lines[a])
        y = position(lines[b], edit.end_character) if edit.end_line < len(lines) else len(lines[b])
    else:
        new = text.split("\n")
        same = next((k for k, (p, q) in enumerate(zip(lines, new)) if p != q), min(len(lines), len(new)))
        rest = next((k for k, (p, q) in enumerate(zip(reversed(lines[same:]), reversed(new[same:]))) if p != q), min(len(lines), len(new)) - same)
        return same, len(lines) - rest, new[same : len(new) - rest]
    if (a, x) > (b, y):
        raise ValueError("an edit ends before it starts")
    return a, b + 1, (lines[a][:x] + text + lines[b][y:]).split("\n")


def _anchors(line: str) -> bool:
    """Whether nothing that stands before a line can matter behind it."""
    return len(set(line.split())) > 1


def _reach(lines: list[str], begin: int, end: int) -> tuple[int, int]:
    """A range of lines with those around it, up and down to the first that anchors."""
    while begin > 0:
        begin -= 1
        if _anchors(lines[begin]):
            break
    while end < len(lines):
        end += 1
        if _anchors(lines[end - 1]):
            break
    return begin, end


def dirty(ids: list[int], others: list[int]) -> list[tuple[int, int]]:
    """Ranges of lines that the other version lacks, or (empty ranges) between which it has others."""
    place = {x: k for k, x in enumerate(others)}
    out, before, at = [], -1, 0
    while at <= len(ids):
        stop = at
        while stop < len(ids) and ids[stop] not in place:
            stop += 1
        after = place[ids[stop]] if stop < len(ids) else len(others)
        if stop > at or after != before + 1:
            out.append((at, stop))
        before, at = after, stop + 1
    return out


def windows(lines: list[str], ids: list[int], others: list[int], whole: bool) -> Iterator[tuple[str, list[int], list[int], int, int]]:
    """(text, ids, starts, first, last) of what changed: starts of lines in the text, and where its own lines begin and end."""
    own = [(0, len(lines))] if whole and ids != others else [] if whole else [_reach(lines, a, b) for a, b in dirty(ids, others)]
    merged: list[list[int]] = []
    for a, b in sorted(own):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        begin, end = (a, b) if whole else _reach(lines, a, b)
        starts, at = [], 0
        for line in lines[begin:end]:
            starts.append(at)
            at += len(line) + 1
        ends = starts[b - begin] if b < end else at
        if a < b:
            yield "\n".join(lines[begin:end]), ids[begin:end], starts, starts[a - begin], ends


class Documents(StatefulProcessor):
    """The state of one document, and the windows that its edits touch."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("document", "next long, version long, source_kind string, ids array<long>, lines array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get()
        following, version, kind, ids, lines = held if held else (0, 0, None, [], [])
        ids, lines = list(ids), list(lines)
        old_ids, old_lines, closed = ids, lines, False
        if not lines:
            ids, lines, following = [following], [""], following + 1
        for edit in sorted(rows, key=lambda r: r.version):
            version, closed, kind = edit.version, bool(edit.closed), edit.source_kind or kind
            if not closed:
                a, b, new = replaced(lines, edit)
                lines = lines[:a] + new + lines[b:]
                ids = ids[:a] + list(range(following, following + len(new))) + ids[b:]
                following += len(new)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if closed:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + FORGET_AFTER)
            ids, lines = [], []
        self.held.update((following, version, kind, ids, lines))
        whole = (kind or "plain_text") not in ("plain", "plain_text")
        for sign, some, own, other in ((-1, old_lines, old_ids, ids), (1, lines, ids, old_ids)):
            for text, named, starts, first, last in windows(some, own, other, whole) if some else ():
                yield Row(uri=key[0], version=version, source_kind=kind or "plain_text", sign=sign, text=text, ids=named, starts=starts, first=first, last=last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def edited_windows(edits: DataFrame) -> DataFrame:
    """The windows (WINDOWS) that a stream of edits (EDITS) touches, by batch."""
    return edits.groupBy("uri").transformWithState(Documents(), WINDOWS, "Update", "ProcessingTime")


def changes(touched: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings that begin in the own lines of windows: with the window's sign, by line id and column (code points)."""
    docs = materialise(touched.withColumn("doc_id", F.monotonically_increasing_id()), "windows")
    found = materialise(lint(docs, config), "found").join(docs.select("doc_id", "uri", "version", "sign", "ids", "starts", "first", "last"), "doc_id")
    found = found.where((F.col("start") >= F.col("first")) & (F.col("start") < F.col("last")))
    at = F.size(F.filter("starts", lambda s: s <= F.col("start"))) - 1
    placed = found.withColumn("line_id", F.get("ids", at)).withColumn("column", (F.col("start") - F.get("starts", at)).cast("int"))
    return placed.select(*CHANGES)


def watch_edits(edits: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: Config = Config(), interval: str | None = None) -> StreamingQuery:
    """Keeps edited documents and hands the changes of their findings to ``sink``, batch by batch.

    Without an interval all edits that are there are processed, and the query ends. The state is in RocksDB below the
    checkpoint, so a query that starts again goes on where it was.
    """
    spark = edits.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = edited_windows(edits).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        writer = writer.foreachBatch(lambda batch, number: sink(changes(batch, config), number))
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def standing(changed: DataFrame) -> DataFrame:
    """The findings that stand after all changes: what was added more often than withdrawn."""
    keys = [c for c in CHANGES if c not in ("version", "sign")]
    return changed.groupBy(*keys).agg(F.sum("sign").cast("long").alias("count")).where(F.col("count") != 0)
