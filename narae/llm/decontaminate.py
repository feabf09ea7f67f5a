"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all factors of the normalised items. Document words are streamed through it, with
the longest matching length kept at each word; where that reaches the window length, the window's
words are hit, and the automaton names the items that contain it. Items shorter than a window count
as one window each; their states are found on the suffix chain of the current state.

The automaton is broadcast. Its size is bounded: items are dealt into blocks of a limited number of
words, each block has an automaton of its own (at most two states a word, in flat arrays), and blocks take
turns. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narae.llm.shared import join_texts, materialise, pieces, raw_texts, small_batches, tidy, word_bounds, word_hashes

WINDOW = 10
#: Words of one automaton at most; beyond that, items go to several blocks.
MOST_WORDS = 2_000_000
#: A document that is hit in more than this share of its words goes altogether.
MOST_COVERAGE = 0.5

_BLANK = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def item_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, letters and anything beyond ASCII."""
    return text.translate(_BLANK).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window, in flat arrays.

    Words are numbered by the order of their 64-bit hashes (``word_hashes``). Most states have one edge, held
    in ``code`` and ``to``; the edges of states with more are in ``more``.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        hashes, first = normal_hashes([text for _, text in items])
        self.words, codes = np.unique(hashes, return_inverse=True)
        self.names = [name for name, _ in items]
        coded = [(k, codes[first[k] : first[k + 1]].tolist()) for k in range(len(items)) if first[k + 1] > first[k]]
        self.code, self.to, self.link, self.length = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        for _, own in coded:
            last = 0
            for c in own:
                last = self._extend(last, c)
        #: The shortest matching suffix with at least a window's length, by state (-1: none).
        self.at_window = array("i", [-1]) * len(self.link)
        by_length = np.argsort(np.frombuffer(self.length, np.intc), kind="stable").tolist()
        for v in by_length:
            if self.length[v] >= window:
                up = self.at_window[self.link[v]]
                self.at_window[v] = v if up < 0 else up
        places: dict[tuple[int, int], None] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for k, own in coded:
            v = 0
            for at, c in enumerate(own, 1):
                v = self._step(v, c)
                if at >= window:
                    places[self.at_window[v], k] = None
            if len(own) < window:
                short.setdefault(v, []).append((len(own), k))
        pairs = np.array(sorted(places), dtype=np.int32).reshape(-1, 2)
        #: Items of the windows, one after another, and the first of each state's.
        self.items = pairs[:, 1].copy()
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(self.link) + 1)).astype(np.int32)
        #: (length, item) of the short items that end where a state's strings end.
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        if short:
            for v in by_length[1:]:
                found = (*self.short.get(self.link[v], ()), *short.get(v, ()))
                if found:
                    self.short[v] = found
        self.least = min([window, *(len(own) for _, own in coded)])

    def _step(self, v: int, c: int) -> int:
        """The state behind v's edge c; 0 if there is none (no edge leads to the start)."""
        if self.code[v] == c:
            return self.to[v]
        return self.more[v].get(c, 0) if v in self.more else 0

    def _set(self, v: int, c: int, target: int) -> None:
        if self.code[v] in (-1, c):
            self.code[v], self.to[v] = c, target
        else:
            self.more.setdefault(v, {})[c] = target

    def _state(self, length: int, link: int, like: int = -1) -> int:
        new = len(self.link)
        self.length.append(length)
        self.link.append(link)
        self.code.append(self.code[like] if like >= 0 else -1)
        self.to.append(self.to[like] if like >= 0 else 0)
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _split(self, p: int, c: int) -> int:
        """The target of p's edge c, cut to the strings that p reaches."""
        q = self._step(p, c)
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = clone
        while p >= 0 and self._step(p, c) == q:
            self._set(p, c, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if self._step(last, c):
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and not self._step(p, c):
            self._set(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def find(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
        """Of each text: its number of words, hit word ranges (merged, in order), and the items with occurring windows."""
        hashes, first = normal_hashes(texts)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        border = np.zeros(len(hashes) + 1, bool)
        border[first] = True
        # Runs of known words within one text: no window spans an unknown word.
        begin = np.flatnonzero(known & (border[:-1] | ~np.concatenate([[False], known[:-1]])))
        end = np.flatnonzero(known & (border[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        wide = end - begin >= self.least
        begin, end = begin[wide], end[wide]
        owner = np.searchsorted(first, begin, side="right") - 1
        hits: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        for a, b, k in zip(begin.tolist(), end.tolist(), owner.tolist()):
            self._stream(a - int(first[k]), at[a:b].tolist(), hits[k], items[k])
        return np.diff(first).tolist(), hits, items

    def _stream(self, start: int, codes: list[int], ranges: list[tuple[int, int]], found: set[int]) -> None:
        code, to, more, link, length, window, short = self.code, self.to, self.more, self.link, self.length, self.window, self.short
        v = matched = 0
        for at, c in enumerate(codes, start + 1):
            while True:
                next_ = to[v] if code[v] == c else more[v].get(c, 0) if v in more else 0
                if next_ or not v:
                    break
                v = link[v]
                matched = length[v]
            v = next_
            if not v:
                matched = 0
                continue
            matched += 1
            hit = 0
            if matched >= window:
                hit = window
                state = self.at_window[v]
                found.update(self.items[self.item_from[state] : self.item_from[state + 1]].tolist())
            if short and v in short:
                for size, item in short[v]:
                    if size <= matched:
                        hit = max(hit, size)
                        found.add(item)
            if hit:
                begin = at - hit
                while ranges and ranges[-1][1] >= begin:
                    begin = min(begin, ranges.pop()[0])
                ranges.append((begin, at))


def normal_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of all texts, and the index of each text's first (n + 1 of them)."""
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    buf, starts = join_texts([t.translate(_BLANK) for t in texts])
    begin, end, first = word_bounds(buf, starts)
    return word_hashes(buf, begin, end), first


def _item_rows(items: DataFrame) -> DataFrame:
    """Distinct (item_id, text); a null id stays null."""
    return items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.encode("text", "UTF-8").alias("text")).distinct()


def _item_blocks(rows: DataFrame, most_words: int = MOST_WORDS) -> int:
    """How many blocks of some ``most_words`` words the items make up."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2 + 1  # a word takes two bytes at least
    return -(-size // most_words)


def _automaton(rows: DataFrame, window: int, block: int, blocks: int) -> Automaton:
    """The automaton of one block of items. Only that block, of bounded size, comes to the driver."""
    mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    coded = sorted(("null" if r[0] is None else r[0], bytes(r[1])) for r in mine.collect())
    return Automaton(coded, window)


_HITS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
#: Columns that a pass adds; a text comes in as ``_text``.
_FOUND = {"_n_words": "long", "_hits": "array<struct<begin:int,end:int>>", "_items": "array<string>"}


def _passes(docs: DataFrame, items: DataFrame, window: int, last, schema: str | None) -> DataFrame:
    """Streams ``docs`` (with the columns of _FOUND) through the automata, one a pass.

    ``last`` makes the rows of the last pass from (batch, n_words, hits, items). Passes before it are written
    down, so that there is one automaton at a time on the driver and in a worker, and one worker a task.
    """
    spark = docs.sparkSession
    rows = _item_rows(items)
    blocks = _item_blocks(rows)
    small_batches(spark)
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(_automaton(rows, window, k, blocks))
        if k + 1 == blocks:
            return docs.mapInArrow(tidy(_streamed(shared, last)), schema)
        docs = materialise(docs.mapInArrow(tidy(_streamed(shared, _kept)), docs.schema), "leaks")
        shared.unpersist()
    raise AssertionError("there is at least one block")


def _streamed(shared, out):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("_text"))
            old_hits, old_items = batch.column(names.index("_hits")), batch.column(names.index("_items"))
            n_words, hits, found = [], [], []
            raw = raw_texts(texts)
            for a, b in pieces(raw):
                for part, more in zip((n_words, hits, found), automaton.find(raw[a:b])):
                    part += more
            items = []
            for k, own in enumerate(found):
                named = {automaton.names[i] for i in own}
                if len(old_hits[k]):
                    hits[k] = merge_ranges([*hits[k], *((h["begin"], h["end"]) for h in old_hits[k].as_py())])
                    named.update(old_items[k].as_py())
                items.append(sorted(named))
            yield out(batch, raw, n_words, hits, items)

    return rows


def _kept(batch: pa.RecordBatch, raw: list[bytes], n_words: list, hits: list, items: list) -> pa.RecordBatch:
    columns = {
        "_n_words": pa.array(n_words, pa.int64()), "_hits": pa.array([[{"begin": a, "end": b} for a, b in r] for r in hits], _HITS), "_items": pa.array(items, pa.list_(pa.string())),
    }
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([columns.get(c, batch.column(k)) for k, c in enumerate(names)], names=names)


def _prepared(docs: DataFrame, columns: list[str]) -> DataFrame:
    nothing = [F.lit(0).cast("long").alias("_n_words"), *[F.array().cast(_FOUND[c]).alias(c) for c in ("_hits", "_items")]]
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.encode("text", "UTF-8").alias("_text"), *nothing)


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, hits (word ranges, end exclusive), items (sorted ids)) of each row of docs.

    Null texts have no words. Items without words are never found; repeated items count once, a null
    id reads "null". Texts of any length are streamed whole. No items: nothing is hit.
    """
    prepared = _prepared(docs, ["doc_id"])
    ident = docs.schema["doc_id"].dataType.simpleString()

    def last(batch, raw, n_words, hits, found) -> pa.RecordBatch:
        full = _kept(batch, raw, n_words, hits, found)
        return pa.RecordBatch.from_arrays([full.column(full.schema.names.index(c)) for c in ("doc_id", "_n_words", "_hits", "_items")], names=["doc_id", "n_words", "hits", "items"])

    return _passes(prepared, items, window, last, f"doc_id {ident}, n_words long, hits array<struct<begin:int,end:int>>, items array<string>")


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def leak_digest(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    found = find_leaks(docs, items, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["begin"])
    found = found.withColumn("n_hit", n_hit)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = MOST_COVERAGE) -> DataFrame:
    """``docs`` without hit spans, and without documents that are hit beyond ``most_coverage``.

    Of a span, its words and what stands between them go; the rest of the text stays as it is.
    ``n_chars`` follows. Clean documents come through unchanged, null texts included; repeated rows are
    judged each. Spans are removed in the pass that finds them.
    """
    columns = docs.columns
    prepared = _prepared(docs, [c for c in columns if c != "text"])
    plain = docs.schema["n_chars"].dataType.typeName() in ("byte", "short", "integer", "long") if "n_chars" in columns else False

    def last(batch: pa.RecordBatch, raw: list[bytes], n_words: list, hits: list, found: list) -> pa.RecordBatch:
        names = batch.schema.names
        kept = [sum(b - a for a, b in h) <= most_coverage * n for h, n in zip(hits, n_words)]
        texts = batch.column(names.index("_text"))
        changed = any(hits)
        if changed:
            valid = texts.is_valid().to_pylist()
            raw = [_without(t, h) if h else t for t, h in zip(raw, hits)]
            texts = pa.array([t if v else None for t, v in zip(raw, valid)], pa.binary())
        out = {"text": texts.cast(pa.string())}
        if plain and changed:
            old = batch.column(names.index("n_chars"))
            out["n_chars"] = pa.array([len(t.decode()) if h else n for t, h, n in zip(raw, hits, old.to_pylist())], old.type)
        rows = pa.RecordBatch.from_arrays([out[c] if c in out else batch.column(names.index(c)) for c in columns], names=columns)
        return rows if all(kept) else rows.filter(pa.array(kept))

    return _passes(prepared, items, window, last, docs.schema)


def _without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    flags = np.frombuffer(data.translate(_BLANK), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    out, at = [], 0
    for a, b in ranges:
        out.append(data[at : begin[a]])
        at = end[b - 1]
    return b"".join([*out, data[at:]])
