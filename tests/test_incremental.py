"""Incremental lint: windows of edits, and the sum of changes against a lint of the whole."""

import random

import pytest
from pyspark.sql import Row

from narae.functions.catalogue import Config
from narae.operators.detect import lint
from narae.streaming import incremental


def edit(uri, version, text="", lines=None, span=None, closed=None, kind=None):
    a, x, b, y = lines or (None,) * 4
    return Row(uri=uri, version=version, source_kind=kind, start_line=a, start_character=x, end_line=b, end_character=y, start_byte=span and span[0], end_byte=span and span[1], text=text, closed=closed)


def apply(lines, e):
    a, b, new = incremental.replaced(lines, e)
    return lines[:a] + new + lines[b:]


def test_edits_of_lines():
    assert apply(["a😀b"], edit("u", 1, "x", (0, 1, 0, 3))) == ["axb"]
    assert apply(["ab", "cd"], edit("u", 1, "x\ny", (0, 1, 1, 1))) == ["ax", "yd"]
    assert apply(["ab"], edit("u", 1, "!", (7, 0, 9, 9))) == ["ab!"]
    assert apply(["가나", "다"], edit("u", 1, "x", None, (3, 7))) == ["가x다"]
    assert incremental.replaced(["a", "b", "c"], edit("u", 1, "a\nx\nc")) == (1, 2, ["x"])
    for span in ((1, 3), (0, 11), (6, 3)):
        with pytest.raises(ValueError):
            apply(["가나"], edit("u", 1, "", None, span))


def test_dirty_ranges():
    assert incremental.dirty([1, 2, 3], [1, 2, 3]) == []
    assert incremental.dirty([1, 9, 3], [1, 2, 3]) == [(1, 2)] and incremental.dirty([1, 3], [1, 2, 3]) == [(1, 1)]
    assert incremental.dirty([1, 2, 7], [1, 2]) == [(2, 3)] and incremental.dirty([], [1]) == [(0, 0)] and incremental.dirty([4], []) == [(0, 1)]


WORDS = ["몇일", "아주", "아주", "되서", "그때", "책를", "금새", "foo", "사과,배", "끝.다음", "", "던지", "가던지", "http://a.kr/몇일", " ", "?"]


class Held:
    """A value state, a handle and a clock, as Spark gives them to the processor."""

    value, timers = None, None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValueState(self, *args):
        return self

    def listTimers(self):
        return iter(self.timers or [])

    def registerTimer(self, at):
        self.timers = [at]

    def deleteTimer(self, at):
        self.timers = None

    def getCurrentProcessingTimeInMs(self):
        return 1000


def run(spark, batches, config=Config("strict")):
    """All changes so far, after each batch of edits: the processor on each document, then the batch lint."""
    docs, out = {}, []
    fields = [f.split()[0] for f in incremental.WINDOWS.split(", ")]
    for batch in batches:
        rows = []
        for uri in sorted({e.uri for e in batch}):
            if uri not in docs:
                docs[uri] = incremental.Documents(), Held()
                docs[uri][0].init(docs[uri][1])
            rows += docs[uri][0].handleInputRows((uri,), (e for e in reversed(batch) if e.uri == uri), docs[uri][1])
        table = spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], incremental.WINDOWS)
        out += incremental.changes(table, config).collect()
        yield list(out)
    assert docs["u0"][1].timers == [1000 + incremental.FORGET_AFTER]
    list(docs["u0"][0].handleExpiredTimer(("u0",), docs["u0"][1], None))
    assert docs["u0"][1].value is None


def test_changes_sum_up_to_a_full_lint(spark):
    """Random edits of documents: after each batch, added less withdrawn findings are those of the texts as they stand."""
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4)))
    docs = {f"u{k}": [""] for k in range(4)}
    batches, texts, version = [], [], 0
    for turn in range(2):
        batch = []
        for uri in docs:
            for _ in range(rng.randint(0 if turn else 1, 4)):
                version += 1
                lines = docs[uri]
                if not turn and lines == [""]:
                    e = edit(uri, version, "\n".join(line() for _ in range(12)))
                elif rng.random() < 0.2:
                    e = edit(uri, version, "\n".join([*lines[:3], line(), *lines[4:]]))
                else:
                    a = rng.randrange(len(lines))
                    b = min(len(lines) - 1, a + rng.choice([0, 0, 1, 3]))
                    x, y = sorted((rng.randint(0, len(lines[a])), rng.randint(0, len(lines[b])))) if a == b else (rng.randint(0, len(lines[a])), rng.randint(0, len(lines[b])))
                    e = edit(uri, version, rng.choice(["", line(), line() + "\n" + line(), "\n"]), (a, x, b, y))
                docs[uri] = apply(lines, e)
                batch.append(e)
        if turn == 1:
            version += 1
            batch.append(edit("u0", version, closed=True))
            docs["u0"] = []
        batches.append(batch)
        texts.append({u: list(x) for u, x in docs.items()})
    seen = 0
    changes = run(spark, batches)
    for rows, wanted in zip(changes, texts, strict=False):
        left = {}
        for r in rows:
            key = (r.uri, r.line_id, r.column, r.original, r.suggestion, r.rule_id, r.turn)
            left[key] = left.get(key, 0) + r.sign
        assert set(left.values()) <= {0, 1}
        by_line = sorted((k[0], *k[2:]) for k, n in left.items() if n)
        table = spark.createDataFrame([(k, u, "\n".join(x)) for k, (u, x) in enumerate(sorted(wanted.items()))], "doc_id long, uri string, text string")
        full = lint(table, Config("strict")).join(table, "doc_id").collect()
        column = lambda r: r.start - (r.text.rfind("\n", 0, r.start) + 1)
        assert by_line == sorted((r.uri, column(r), r.original, r.suggestion, r.rule_id, r.turn) for r in full)
        assert len(full) > 10
        assert len(rows) > seen
        seen = len(rows)
    assert next(changes, None) is None  # what comes after the last batch


def test_untouched_lines_stay_out(spark):
    lines = [f"몇일 동안 {k} 금새" for k in range(1000)]
    ids = list(range(1000))
    changed = incremental.replaced(lines, edit("u", 2, "x", (500, 0, 500, 2)))
    new = lines[:500] + changed[2] + lines[501:]
    (found,) = incremental.windows(new, ids[:500] + [1000] + ids[501:], ids, False)
    assert len(found[1]) == 5 and found[0].split("\n") == new[498:503]
    assert found[3] == found[2][1] and found[4] == found[2][4]
    (whole,) = incremental.windows(new, ids[:500] + [1000] + ids[501:], ids, True)
    assert len(whole[1]) == 1000
    table = spark.createDataFrame([("u", 1, 1, 0, 0, "몇일", "며칠", "r", "error", True, 0), ("u", 2, -1, 0, 0, "몇일", "며칠", "r", "error", True, 0), ("u", 2, 1, 3, 0, "몇일", "며칠", "r", "error", True, 0)], "uri string, version long, sign int, line_id long, column int, original string, suggestion string, rule_id string, severity string, safe boolean, turn int")
    assert [(r.line_id, r["count"]) for r in incremental.standing(table).collect()] == [(3, 1)]
