"""Conversation structure repair: the cheapest edits that make roles alternate, found by a rank-compressed search.

Roles must read ``(s?(ua)+)?``: nothing, or one system turn at most and then user and assistant in turn. A turn
and the insertions before it are one macro edit, a run of I and then D, K or R. As each macro ends with its
turn's letter, macros are a prefix-free code, and audits of equal many turns compare macro by macro. So a layer
keeps for each state of the automaton no audit, but its cost, the rank of its audit among the layer's, and a
pointer to the parent state with the macro's code; the audit is put together from the pointers.

Rows of a conversation stream through one task in order (the digest of the repaired text has to), sorted by
Spark, which spills. Pointers and texts are held only back to where the paths of all states that can still win
have a common ancestor; edits up to there are settled and go out.

Odd rows: a null role or text is one blank, in the key of the damage a null id or turn as well; null turns come
first; equal turns go by role and text, a repeated row behind its original. A role begins with s, u or a in
lower case, or can't be kept. Conversations without rows after the damage have zeros and an empty audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narae.llm.shared import parts_for, small_batches, tidy

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: States: nothing yet, after the system turn, after a user's, after an assistant's. A conversation may end in two.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: More insertions than two in a row lead back to where they began.
MOST_INSERTS = 2
MACROS = sorted("I" * k + letter for k in range(MOST_INSERTS + 1) for letter in "DKR")
#: Turns, or characters of text, after which settled edits are looked for.
SETTLE_TURNS, SETTLE_CHARS = 64, 1 << 20
FAULTS = 20


def _inserted(state: int, k: int) -> tuple[int, str] | None:
    """Where k insertions lead, and their roles."""
    roles = ""
    for _ in range(k):
        role = next((r for r in "ua" if (state, r) in NEXT), None)
        if role is None:
            return None
        state, roles = NEXT[state, role], roles + role
    return state, roles


def _macros(initial: str, must_delete: bool, truncated: bool) -> list[tuple[int, int, int, int, str]]:
    """(from, to, cost, code, roles) of all macro edits on such a turn; roles: those of the insertions and of the turn."""
    out = []
    kept = TRUNCATED if truncated else 0
    for begin in range(4):
        for k in range(MOST_INSERTS + 1):
            at = _inserted(begin, k)
            if at is None:
                continue
            state, roles = at
            out.append((begin, state, k * INSERT + DELETE, MACROS.index("I" * k + "D"), roles))
            if must_delete:
                continue
            if (state, initial) in NEXT:
                out.append((begin, NEXT[state, initial], k * INSERT + KEEP + kept, MACROS.index("I" * k + "K"), roles + initial))
            out += [(begin, NEXT[state, r], k * INSERT + REROLE + kept, MACROS.index("I" * k + "R"), roles + r) for r in ROLES if (state, r) in NEXT]
    return out


_TABLE: dict[tuple, list] = {}


def macros(initial: str, must_delete: bool, truncated: bool) -> list[tuple[int, int, int, int, str]]:
    key = (initial if initial in "sua" else "", must_delete, truncated)
    if key not in _TABLE:
        _TABLE[key] = _macros(*key)
    return _TABLE[key]


#: (losing, winning): what it costs at most to do from the second state whatever follows from the first.
_DETOURS = {
    (START, ASSISTANT): DELETE, (SYSTEM, ASSISTANT): 0, (USER, ASSISTANT): INSERT, (ASSISTANT, USER): INSERT,
    (START, USER): INSERT + DELETE, (SYSTEM, USER): INSERT,
}


class Repair:
    """The search over one conversation. ``push`` takes turns in order; what is settled comes out as (edit, role, text)."""

    def __init__(self) -> None:
        self.cost = {START: 0}
        self.rank = {START: 0}
        self.layers: list[dict[int, tuple[int, int, str]]] = []  # state: (parent, code, roles)
        self.turns: list[tuple[str, str]] = []
        self.chars = 0

    def push(self, role: str, text: str, must_delete: bool, truncated: bool) -> list[tuple[str, str, str]]:
        best: dict[int, tuple[int, int, int, int, str]] = {}
        cost, rank = self.cost, self.rank
        for begin, end, more, code, roles in macros(role[:1], must_delete, truncated):
            if begin in cost:
                found = (cost[begin] + more, rank[begin], code, begin, roles)
                if end not in best or found[:3] < best[end][:3]:
                    best[end] = found
        # Ranks of the layer: by the parent's rank, then by code; equal audits have equal ranks.
        order = {key: k for k, key in enumerate(sorted({b[1:3] for b in best.values()}))}
        alive = {}
        for state, b in best.items():
            if not any((state, other) in _DETOURS and b[0] > best[other][0] + _DETOURS[state, other] for other in best):
                alive[state] = b
        self.cost = {s: b[0] for s, b in alive.items()}
        self.rank = {s: order[b[1:3]] for s, b in alive.items()}
        self.layers.append({s: (b[3], b[2], b[4]) for s, b in alive.items()})
        self.turns.append((role, text))
        self.chars += len(text)
        if len(self.turns) >= SETTLE_TURNS and len(self.turns) % SETTLE_TURNS == 0 or self.chars >= SETTLE_CHARS:
            return self._settled()
        return []

    def _settled(self) -> list[tuple[str, str, str]]:
        """Edits up to the last layer where all paths meet in one state."""
        states = set(self.cost)
        for k in range(len(self.layers) - 1, -1, -1):
            if len(states) == 1:
                out = self._path(k, states.pop())
                del self.layers[: k + 1], self.turns[: k + 1]
                self.chars = sum(len(t) for _, t in self.turns)
                return out
            states = {self.layers[k][s][0] for s in states}
        return []

    def _path(self, last: int, state: int) -> list[tuple[str, str, str]]:
        """The edits of the held turns up to one, which ends in a state."""
        back = []
        for k in range(last, -1, -1):
            parent, code, roles = self.layers[k][state]
            back.append((code, roles, self.turns[k]))
            state = parent
        out = []
        for code, roles, (role, text) in reversed(back):
            macro = MACROS[code]
            out += [("I", ROLES[r], "") for r in roles[: len(macro) - 1]]
            out.append((macro[-1], {"D": "", "K": role, "R": ROLES.get(roles[-1:], "")}[macro[-1]], text))
        return out

    def finish(self) -> tuple[int, list[tuple[str, str, str]]]:
        """The cost of all, and the edits that were not settled yet."""
        ends = []
        for state, cost in self.cost.items():
            for k in range(MOST_INSERTS + 1):
                at = _inserted(state, k)
                if at and at[0] in ENDS:
                    ends.append((cost + k * INSERT, self.rank[state], k, state, at[1]))
        cost, _, _, state, roles = min(ends)
        return cost, self._path(len(self.layers) - 1, state) + [("I", ROLES[r], "") for r in roles]


# --- rows ------------------------------------------------------------------------------------


def _or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows with the faults that crc32 of ``conv_id:turn`` gives them.

    Of twenty kinds five do something: the row is dropped (kept as a mark), emptied, loses its ``.!?``, stands
    twice, or becomes the user's. Others stay.
    """
    key = F.concat(_or_blank(F.col("conv_id")), F.lit(":"), _or_blank(F.col("turn")))
    fault = F.crc32(key.cast("binary")) % FAULTS
    text = _or_blank(F.col("text"))
    made = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(_or_blank(F.col("role"))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (fault == 0).alias("dropped"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return made.drop("_copy")


_BLANK = r"[^\x20\x09-\x0D]"
_CLOSED = r"[.!?][\x20\x09-\x0D]*\z"


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of each conversation in one partition and in order, with what is wrong with them: fault 0 nothing, 1
    blank, 2 duplicate, 3 truncated. One exchange; both sorts are Spark's, so a large conversation spills."""
    dealt = rows.withColumn("_mark", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).repartition(parts_for(rows), "conv_id")
    again = F.row_number().over(W.partitionBy("conv_id", "dropped", "_mark").orderBy(F.asc_nulls_first("turn")))  # within the partitions
    fault = F.when(~F.col("text").rlike(_BLANK), 1).when(F.col("_again") > 1, 2).when(~F.col("text").rlike(_CLOSED), 3).otherwise(0)
    marked = dealt.withColumn("_again", again).withColumn("fault", fault)
    return marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "_again").drop("_mark", "_again")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, role, text, dropped, fault) of all batches; a conversation may go on in the next batch."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "fault")))


class _Summary:
    """What is told of a conversation: counts of its rows, cost, audit and the digest of its repaired text."""

    def __init__(self, ident) -> None:
        self.ident, self.repair, self.digest = ident, Repair(), hashlib.sha256()
        self.audit: list[str] = []
        self.counts = [0, 0, 0, 0]
        self.turns, self.first, self.last, self.illegal, self.before, self.lines = 0, None, None, 0, None, 0

    def take(self, edits: list[tuple[str, str, str]]) -> None:
        self.audit.append("".join(e[0] for e in edits))
        for letter, role, text in edits:
            if letter != "D":
                self.digest.update((b"\n" if self.lines else b"") + role.encode() + b":" + text.encode())
                self.lines += 1

    def push(self, turn, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.take(self.repair.push(role, text, fault in (1, 2), fault == 3))

    def row(self) -> tuple:
        cost, edits = self.repair.finish()
        self.take(edits)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.ident, gaps, *self.counts[1:], self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def repair_digest(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    rows: (conv_id, turn, role, text[, dropped]); rows that are dropped only name their conversation.
    """
    small_batches(rows.sparkSession)
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    rows = rows.select("conv_id", "turn", _or_blank(F.col("role")).alias("role"), _or_blank(F.col("text")).alias("text"), "dropped")
    ordered = in_order(rows)
    form = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    kind = ordered.schema["conv_id"]
    names = ["conv_id", *(f.split()[0] for f in form.split(", "))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, types = None, [], None
        for ident, turn, role, text, dropped, fault in _conversations(_noted(batches, seen := [])):
            types = seen[0]
            if now is None or now.ident != ident:
                if now is not None:
                    out.append(now.row())
                now = _Summary(ident)
            if not dropped:
                now.push(turn, role, text, fault)
            if len(out) >= 4096:
                yield _batch(out, names, types)
                out = []
        if now is not None:
            yield _batch([*out, now.row()], names, types)

    return ordered.mapInArrow(tidy(summed), f"conv_id {kind.dataType.simpleString()}, {form}")


def _noted(batches: Iterator[pa.RecordBatch], seen: list) -> Iterator[pa.RecordBatch]:
    """Batches as they are; the type of their ids goes to ``seen``."""
    for batch in batches:
        seen[:] = [batch.schema.field("conv_id").type]
        yield batch


def _batch(rows: list[tuple], names: list[str], ident: pa.DataType) -> pa.RecordBatch:
    kinds = [ident, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of the repaired conversations: what was kept, given another role or inserted.

    place: from 0 in each conversation. Conversations that end empty have no rows.
    """
    small_batches(rows.sparkSession)
    if "dropped" not in rows.columns:
        rows = rows.withColumn("dropped", F.lit(False))
    rows = rows.select("conv_id", "turn", _or_blank(F.col("role")).alias("role"), _or_blank(F.col("text")).alias("text"), "dropped").where("not dropped")
    ordered = in_order(rows)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = []
        out: list[tuple] = []
        ident, repair, place, chars = None, None, 0, 0

        def take(edits) -> None:
            nonlocal place, chars
            for letter, role, text in edits:
                if letter != "D":
                    out.append((ident, place, role, text, letter))
                    place, chars = place + 1, chars + len(text)

        def flushed() -> pa.RecordBatch:
            nonlocal chars
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [seen[0], pa.int64(), pa.string(), pa.string(), pa.string()])], names=["conv_id", "place", "role", "text", "edit"])
            out.clear()
            chars = 0
            return batch

        for own, _, role, text, _, fault in _conversations(_noted(batches, seen)):
            if repair is None or own != ident:
                if repair is not None:
                    take(repair.finish()[1])
                ident, repair, place = own, Repair(), 0
            take(repair.push(role, text, fault in (1, 2), fault == 3))
            if len(out) >= 4096 or chars >= SETTLE_CHARS:
                yield flushed()
        if repair is not None:
            take(repair.finish()[1])
        if out:
            yield flushed()

    return ordered.mapInArrow(tidy(edited), f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, place long, role string, text string, edit string")
