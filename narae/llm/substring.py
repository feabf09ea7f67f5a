"""Substring dedup by level-wise doubling.

Lengths double up to the target length (each is half of the next, rounded up, down to FIRST words or
fewer; 13 words: 7, 13; 50 words: 7, 13, 25, 50). Windows repeated at one length alone are extended to the
next, until the target length is reached or no candidates survive. Below the target length only the window
of smallest hash within each target window is counted: equal target windows agree on it, so no candidate is
lost, and at the first length about a quarter of the windows is left. Windows travel as packed hashes, dealt out by hash; what repeats within one piece of input is
settled there and sends one representative, so that a passage shared by a third of all documents
costs one entry a piece. Texts move only for documents with surviving candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narae.llm.shared import NO_ID, join_texts, materialise, mix, only_listed, parts_for, pieces, raw_texts, row_key, runs_of, small_batches, tidy, window_hashes, windows_inside, word_bounds, word_hashes

WINDOW = 13
#: Words of a window at the first length at most.
FIRST = 7

#: Rows of the exchanges: documents (their words as a whole), windows to be counted, and findings.
DOCUMENT, ASKED, FOUND = 0, 1, 2
_ROWS = "kind int, part int, key long, n_words long, n_removed long, sha string, payload binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _least_hashes(words: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each window the least hash of the shorter windows within it."""
    grams = window_hashes(words, length)
    n = len(words) - window + 1
    out = grams[: max(n, 0)].copy()
    for k in range(1, window - length + 1):
        np.minimum(out, grams[k : k + n], out=out)
    return out


def _ask(low: np.ndarray, high: np.ndarray, keys: np.ndarray, parts: int, settled: Callable) -> list[tuple]:
    """Rows for the windows of one piece: one entry a distinct window, the smallest key for it.

    settled(first): which of the sorted entries are findings already; first marks their groups' starts.
    """
    order = np.lexsort((keys, high, low))
    low, high, keys = low[order], high[order], keys[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (keys[1:] != keys[:-1])
    low, high, keys = low[new], high[new], keys[new]
    first = np.ones(len(low), dtype=bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    here = settled(first)
    rows = _findings(keys[here], low[here], parts)
    low, high, keys = low[first], high[first], keys[first]
    part = (low % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = runs_of(part[order])
    for a, b in zip(edge, edge[1:]):
        some = order[a:b]
        rows.append((ASKED, int(part[some[0]]), None, None, None, None, np.stack([low[some], high[some], keys[some].view(np.uint64)]).tobytes()))
    return rows


def _findings(keys: np.ndarray, low: np.ndarray, parts: int) -> list[tuple]:
    """Found windows with their documents, one row a destination."""
    part = (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = runs_of(part[order])
    rows = []
    for a, b in zip(edge, edge[1:]):
        some = order[a:b]
        rows.append((FOUND, int(part[some[0]]), None, None, None, None, np.stack([keys[some].view(np.uint64), low[some]]).tobytes()))
    return rows


def _answer(found: Callable, parts: int) -> Callable:
    """Passes rows on, but counts the windows that all pieces asked about."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[np.ndarray] = []
        for batch in batches:
            kind = batch.column(0).to_numpy()
            asked += [np.frombuffer(v.as_buffer(), np.uint64).reshape(3, -1) for v in batch.filter(pa.array(kind == ASKED)).column(6)]
            yield batch.filter(pa.array(kind != ASKED))
        if asked:
            low, high, keys = np.concatenate(asked, axis=1)
            keys = keys.view(np.int64)
            order = np.lexsort((keys, high, low))
            low, high, keys = low[order], high[order], keys[order]
            first = np.ones(len(low), dtype=bool)
            first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            here = found(first, keys)
            yield _batch(_findings(keys[here], low[here], parts))

    return rows


def _group_start(first: np.ndarray) -> np.ndarray:
    """For each sorted entry the index of its group's start."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _group_last(first: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(first)
    return np.repeat(np.append(starts[1:], len(first)) - 1, np.diff(np.append(starts, len(first))))


def _exchange(rows: DataFrame, found: Callable, parts: int, name: str) -> DataFrame:
    return materialise(rows.repartition(parts, "part").mapInArrow(tidy(_answer(found, parts)), _ROWS), name)


def _collected(rows: DataFrame, parts: int) -> DataFrame:
    """(_key, found): the packed findings of each document that has any."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(v.as_buffer(), np.uint64).reshape(2, -1) for batch in batches for v in batch.column(0)]
        if not got:
            return
        keys, low = np.concatenate(got, axis=1)
        keys = keys.view(np.int64)
        order = np.lexsort((low, keys))
        keys, low = keys[order], low[order]
        edge = runs_of(keys)
        for at in range(0, len(edge) - 1, 4096):
            some = edge[at : at + 4097]
            found = [np.unique(low[a:b]).tobytes() for a, b in zip(some, some[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys[some[:-1]]), pa.array(found, pa.binary())], names=["_key", "found"])

    found = rows.where(F.col("kind") == FOUND).select("payload", "part").repartition(parts, "part").select("payload")
    return found.mapInArrow(tidy(gather), "_key long, found binary")


def _several(first: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Entries of windows that several documents have."""
    return keys[_group_start(first)] != keys[_group_last(first)]


def levels(window: int) -> list[int]:
    """The window lengths, from the first to the target."""
    out = [window]
    while out[0] > FIRST or len(out) == 1:
        out.insert(0, -(-out[0] // 2))
    return out


def repeated_windows(docs: DataFrame, window: int = WINDOW, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, removals): every row's (key, n_words, sha of all words), and by key the low hashes
    of its windows that also start in a document with a smaller key."""
    parts = parts or parts_for(docs)
    lengths = levels(window)
    small_batches(docs.sparkSession)
    texts = docs.select(row_key().alias("_key"), F.encode("text", "UTF-8").alias("_text"))

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_keys, all_texts = batch.column(0).to_numpy(), raw_texts(batch.column(1))
            for a, b in pieces(all_texts):
                keys = all_keys[a:b]
                buf, starts = join_texts(all_texts[a:b])
                begin, end, first = word_bounds(buf, starts)
                rows = [
                    (DOCUMENT, int(k) & 0x7FFFFFFF, int(k), int(n), 0, hashlib.sha256(b" ".join(t.split())).hexdigest(), None)
                    for k, n, t in zip(keys, np.diff(first), all_texts[a:b])
                ]
                at, text = windows_inside(first, window)
                if len(at):
                    low = _least_hashes(word_hashes(buf, begin, end), lengths[0], window)[at]
                    new = np.ones(len(low), dtype=bool)
                    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                    low, own = low[new], keys[text[new]]
                    rows += _ask(low, np.zeros_like(low), own, parts, _settled)
                yield _batch(rows)

    def next_level(before: int, length: int) -> Callable:
        """Of the windows that survived at the length before, what they are at this one."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                all_keys, all_texts, found = batch.column(0).to_numpy(), raw_texts(batch.column(1)), batch.column(2)
                for a, b in pieces(all_texts):
                    low, high, own = [], [], []
                    for key, text, known in zip(all_keys[a:b], all_texts[a:b], found.slice(a, b - a)):
                        buf, starts = join_texts([text])
                        begin, end, _ = word_bounds(buf, starts)
                        words = word_hashes(buf, begin, end)
                        at = np.flatnonzero(_member(_least_hashes(words, before, window), np.frombuffer(known.as_buffer(), np.uint64)))
                        low.append(_least_hashes(words, length, window)[at])
                        # The target windows are told apart by a second hash.
                        high.append(window_hashes(word_hashes(buf, begin, end, 1), window, 1)[at] if length == window else np.zeros(len(at), np.uint64))
                        own.append(np.full(len(at), key))
                    low, high, own = np.concatenate(low), np.concatenate(high), np.concatenate(own)
                    if len(low):
                        yield _batch(_ask(low, high, own, parts, _settled if length < window else lambda first: ~first))

        return rows

    counted = _exchange(texts.mapInArrow(tidy(first_level), _ROWS), _several, parts, "substring-1")
    documents = counted.where(F.col("kind") == DOCUMENT)
    survivors = materialise(_collected(counted, parts), "substring-candidates")
    for before, length in zip(lengths, lengths[1:]):
        if survivors.limit(1).count() == 0:
            return documents, survivors
        wanted = only_listed(texts, survivors.select("_key"), "_key").join(survivors, "_key").select("_key", "_text", "found")
        test = _several if length < window else lambda first, keys: keys != keys[_group_start(first)]
        found = _exchange(wanted.mapInArrow(tidy(next_level(before, length)), _ROWS), test, parts, f"substring-{length}")
        survivors = _collected(found, parts)
        if length < window:
            survivors = materialise(survivors, "substring-candidates")
    return documents, survivors


def _settled(first: np.ndarray) -> np.ndarray:
    """Entries of windows that several documents of one piece have."""
    return _group_start(first) != _group_last(first)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values if len(known) else np.zeros(len(values), dtype=bool)


def covered_words(text: bytes, removed: np.ndarray, window: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and which of them a removed window covers."""
    buf, starts = join_texts([text])
    begin, end, _ = word_bounds(buf, starts)
    hit = _member(window_hashes(word_hashes(buf, begin, end), window), removed)
    edge = np.zeros(len(begin) + 1, dtype=np.int64)
    edge[: len(hit)] += hit
    edge[window : window + len(hit)] -= hit
    return text.split(), np.cumsum(edge[:-1]) > 0


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document.

    Removed is each word covered by a window of ``window`` words that also starts in a document with a
    smaller doc_id, as judged on the input. Null texts have no words. Rows with the same doc_id are
    one document and never remove each other's words; a null doc_id comes after all others.
    """
    documents, removals = repeated_windows(docs, window)
    removals = materialise(removals, "substring-removals")
    texts = docs.select(row_key().alias("_key"), F.encode("text", "UTF-8").alias("_text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, found in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2)):
                removed = np.frombuffer(found.as_buffer(), np.uint64)
                words, covered = covered_words(text, removed, window)
                kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c])
                out.append((DOCUMENT, 0, key, len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest(), None))
            yield _batch(out)

    wanted = only_listed(texts, removals.select("_key"), "_key").join(removals, "_key").select("_key", "_text", "found")
    cut = wanted.mapInArrow(tidy(rows), _ROWS)
    whole = documents.join(removals.select(F.col("_key").alias("key")), "key", "left_anti")
    out = whole.select("key", "n_words", "n_removed", "sha").unionByName(cut.select("key", "n_words", "n_removed", "sha"))
    ident = F.when(F.col("key") != NO_ID, F.col("key")).cast(docs.schema["doc_id"].dataType)
    return out.select(ident.alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the text cut to the words that stay, joined by blanks, where any go."""
    _, removals = repeated_windows(docs, window)
    columns = docs.columns
    rows = docs.withColumn("_key", row_key()).join(removals, "_key", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.schema.names.index("text"), batch.column("text").to_pylist()
            for k, found in enumerate(batch.column("found")):
                if found.is_valid and texts[k] is not None:
                    removed = np.frombuffer(found.as_buffer(), np.uint64)
                    words, covered = covered_words(texts[k].encode(), removed, window)
                    texts[k] = b" ".join([w for w, c in zip(words, covered.tolist()) if not c]).decode()
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return rows.mapInArrow(tidy(cut), rows.schema).select(*[F.col(f"`{c}`") for c in columns])
