"""Token-id files: static range asymmetric numeral system (rANS) with shared frequency tables.

A file holds whole documents in ascending doc_id order. Its ids share one static frequency table and
are coded in independent blocks of interleaved lanes; the block directory gives each block's byte
offset, first id, lane states and checksum, so that blocks decode in parallel. Files are written by
Spark's text writer (raw bytes, then a line feed) and read with its binary file source, on any file
system that Spark reaches.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narae.llm.shared import PIECE, lower_ascii, materialise, pieces, raw_texts, release, scratch_path, small_batches, tidy

END_ID = 2
MAGIC = b"NRNS1\0"
#: Frequencies of a table sum to 2 ** SCALE; states stay in [2 ** 16, 2 ** 32).
SCALE = 16
LOWEST = 1 << 16
#: Lanes of a block, and ids of a block at most.
LANES, BLOCK = 1024, 1 << 18
#: Ids of a file, beyond which it ends after the current document.
FILE_IDS = 1 << 21
#: Words that a worker remembers the ids of; of more it keeps the first, which are the frequent ones.
CACHE_WORDS, KEPT_WORDS = 1_000_000, 300_000
#: Stands between words that are encoded together; words that have it in them are encoded alone.
DIVIDER = b"|"


# Normaliser and split of vocabularies whose texts fall apart into words. Others take whole texts.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


# --- coding ----------------------------------------------------------------------------------


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and frequencies of 1 or more that sum to 2 ** SCALE."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    if len(symbols) > 1 << SCALE:
        raise ValueError("more distinct ids than a table holds")
    if not len(symbols):
        return symbols, counts
    room = (1 << SCALE) - len(symbols)
    exact = counts * (room / counts.sum())
    freq = 1 + np.floor(exact).astype(np.int64)
    short = (1 << SCALE) - int(freq.sum())
    freq[np.lexsort((symbols, -(exact - np.floor(exact))))[:short]] += 1
    return symbols, freq


def encode_block(codes: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane states (uint32) and 16-bit words of symbol indexes, filled up with index 0 to whole steps."""
    lanes = min(LANES, max(1, len(codes)))
    steps = -(-len(codes) // lanes)
    grid = np.zeros(steps * lanes, dtype=np.int32)
    grid[: len(codes)] = codes
    grid = grid.reshape(steps, lanes)
    state = np.full(lanes, LOWEST, dtype=np.uint64)
    out: list[np.ndarray] = []
    for row in grid[::-1]:
        f = freq[row]
        full = state >= f << np.uint64(32 - SCALE)
        out.append(state[full].astype("<u2"))
        state[full] >>= np.uint64(16)
        whole, rest = np.divmod(state, f)
        state = (whole << np.uint64(SCALE)) + rest + start[row]
    return state.astype("<u4"), np.concatenate(out[::-1]) if out else np.empty(0, "<u2")


def decode_block(states: np.ndarray, words: np.ndarray, n: int, freq: np.ndarray, start: np.ndarray, slots: np.ndarray) -> np.ndarray:
    lanes = len(states)
    state, at = states.astype(np.uint64), 0
    out = np.empty((-(-n // lanes), lanes), dtype=slots.dtype)
    words = words.astype(np.uint64)
    for step in range(len(out)):
        slot = state & np.uint64((1 << SCALE) - 1)
        code = slots[slot]
        out[step] = code
        state = freq[code] * (state >> np.uint64(SCALE)) + slot - start[code]
        low = np.flatnonzero(state < LOWEST)
        state[low] = state[low] << np.uint64(16) | words[at : at + len(low)]
        at += len(low)
    if at != len(words) or not (state == LOWEST).all():
        raise ValueError("a block does not decode to its start")
    return out.reshape(-1)[:n]


def write_file(place: tuple[int, int], doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One token file: header, table, documents, block directory, blocks, checksum.

    place: the partition and the number in it, by which files are in order.
    """
    symbols, freq = frequency_table(ids)
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    places = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, dtype=np.int32)
    places[symbols] = np.arange(len(symbols))
    codes, freq64 = places[ids], freq.astype(np.uint64)
    directory, blocks, at = [], [], 0
    for first in range(0, len(ids), BLOCK):
        part = ids[first : first + BLOCK]
        states, words = encode_block(codes[first : first + BLOCK], freq64, start)
        body = states.tobytes() + words.tobytes()
        directory.append(struct.pack("<QQIIII", at, first, len(part), len(states), len(words), zlib.crc32(part.astype("<u4").tobytes())))
        blocks.append(body)
        at += len(body)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    head = struct.pack("<6sIIIIIQ", MAGIC, *place, len(symbols), len(doc_ids), len(directory), len(ids))
    data = b"".join([head, symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), known.tobytes(), numbers.tobytes(), counts.astype("<u8").tobytes(), *directory, *blocks])
    return data + struct.pack("<I", zlib.crc32(data))


def read_file(data: bytes) -> tuple[tuple[int, int], list[int | None], np.ndarray, np.ndarray]:
    """What write_file was given. Damage raises ValueError."""
    if data[:6] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("not a token file, or damaged")
    head = "<6sIIIIIQ"
    _, part, number, n_symbols, n_docs, n_blocks, n_ids = struct.unpack_from(head, data)
    at = struct.calcsize(head)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    symbols, freq = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.uint64)
    known, numbers, counts = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs)
    start = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(n_symbols, dtype=np.int32), freq.astype(np.int64))
    entries = [struct.unpack_from("<QQIIII", data, at + k * 32) for k in range(n_blocks)]
    base = at + n_blocks * 32
    ids = np.empty(n_ids, dtype="<u4")
    for offset, first, n, lanes, n_words, crc in entries:
        states = np.frombuffer(data, "<u4", lanes, base + offset)
        words = np.frombuffer(data, "<u2", n_words, base + offset + 4 * lanes)
        ids[first : first + n] = symbols[decode_block(states, words, n, freq, start, slots)]
        if zlib.crc32(ids[first : first + n].tobytes()) != crc:
            raise ValueError("a block has another checksum")
    doc_ids = [int(d) if k else None for d, k in zip(numbers, known)]
    return (part, number), doc_ids, counts.astype(np.int64), ids


# --- tokenising ------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers words in order of their first sight, and keeps the new ones."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord("."), ord(",")]] = True
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def plain_form(text: bytes) -> bytes:
    """A text with the same ids and fewer distinct words.

    A stop between a letter (A-Z) and white space is a piece of its own, so it may as well be set off.
    Letters may be lower-cased ahead of the tokenizer, unless a combining mark (U+0300 to U+037F)
    could first compose with one, or a special token come of it.
    """
    data = np.frombuffer(text, np.uint8)
    if len(data) > 2:
        stops = np.flatnonzero(_STOP[data])
        inner = stops[(stops > 0) & (stops < len(data) - 1)]
        inner = inner[_LETTER[data[inner - 1]] & _WHITE[data[inner + 1]]]
        if len(inner):
            text = np.insert(data, inner, 32).tobytes()
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else lower_ascii(text)


class WordEncoder:
    """Ids of whole texts, with the ids of words remembered.

    Where the tokenizer's pieces never span white space and it drops white space (as its normaliser and
    split tell), a text's ids are those of its words (as split at ASCII blanks) in turn, and each distinct
    word is encoded by the tokenizer. With any other vocabulary whole texts are.
    """

    def __init__(self, path: str, most: int = 0, kept: int = 0):
        self.path, self._tokenizer = path, None
        self.most, self.kept = most or CACHE_WORDS, kept or KEPT_WORDS
        form = json.loads(self.tokenizer.to_str())
        split = form.get("pre_tokenizer") or {}
        self.by_words = form.get("normalizer") == WORD_NORMALIZER and split.get("type") == "Sequence" and split["pretokenizers"][0] == WORD_SPLIT
        alone = self.tokenizer.encode(DIVIDER.decode(), add_special_tokens=False).ids
        self.divider = alone[0] if len(alone) == 1 else -1
        self.numbers = _Numbers()
        self.first, self.ids = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint32)

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel; threads hold memory each
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def rest(self) -> None:
        """Between tasks the tokenizer goes, and words beyond those to be kept, if few are remembered."""
        if self.most < CACHE_WORDS:
            self._tokenizer = None
            if len(self.numbers) > self.kept:
                self.forget()

    def forget(self) -> None:
        """Keeps the first words."""
        kept = _Numbers()
        kept.update((w, n) for w, n in self.numbers.items() if n < self.kept)
        self.numbers, self.first = kept, self.first[: self.kept + 1].copy()
        self.ids = self.ids[: self.first[-1]].copy()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text with the end id, and all those ids."""
        if not self.by_words:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(map(len, coded), np.int64, len(coded)) + 1, np.fromiter(chain.from_iterable([*c, END_ID] for c in coded), np.uint32)
        if len(self.numbers) > self.most:
            self.forget()
        words = [plain_form(t).split() for t in texts]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
        self._learn()
        sizes = (self.first[1:] - self.first[:-1])[numbers]
        total = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.concatenate([[0], np.cumsum(n_words)])
        of_text = np.diff(total[edge])
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.first[numbers] - total[:-1], sizes)]
        return of_text + 1, np.insert(flat, total[edge[1:]], END_ID)

    def _learn(self) -> None:
        """Encodes new words, many in a text, told apart by a word that is one id of its own."""
        new, self.numbers.new = self.numbers.new, []
        firsts, ids = [self.first], [self.ids]
        for at in range(0, len(new), 1 << 14):
            some = new[at : at + (1 << 14)]
            apart = self.divider < 0 or DIVIDER in b"".join(some)
            coded = self._apart(some) if apart else self._together(some)
            ids.append(coded[0])
            firsts.append(firsts[-1][-1] + coded[1])
        self.first, self.ids = np.concatenate(firsts), np.concatenate(ids)

    def _apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(coded), np.uint32), np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        between = b" " + DIVIDER + b" "
        texts = [(between.join(words[k : k + 512]) + between).decode() for k in range(0, len(words), 512)]
        coded = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
        divides = coded == self.divider
        return coded[~divides], np.flatnonzero(divides) - np.arange(len(words))


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, most: int = 0, kept: int = 0) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if (path, most, kept) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, most, kept] = WordEncoder(path, most, kept)
    return _ENCODERS[path, most, kept]


# --- DataFrames ------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, vocabulary: str, path: str, file_ids: int = FILE_IDS, words: tuple[int, int] = (0, 0)) -> None:
    """Token files of all whole texts, in ascending doc_id order (null first, equal ids by text).

    words: how many words a worker remembers, and keeps when there are more (0: the usual numbers).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        names, counts, ids, held = [], [], [], 0
        coder = encoder(vocabulary, *words)
        for batch in batches:
            all_names, texts = batch.column(0).to_pylist(), raw_texts(batch.column(1))
            for a, b in pieces(texts, PIECE // 4):
                own, flat = coder.encode(texts[a:b])
                names += all_names[a:b]
                counts.append(own)
                ids.append(flat)
                held += len(flat)
                if held >= file_ids:
                    yield _row(write_file((part, number), names, np.concatenate(counts), np.concatenate(ids)))
                    names, counts, ids, held, number = [], [], [], 0, number + 1
                    release()
        if names:
            yield _row(write_file((part, number), names, np.concatenate(counts), np.concatenate(ids)))
        coder.rest()

    texts = docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(tidy(rows), "data binary")
    files.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _row(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, part, number, place[, ids]) of the documents in token files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                (part, number), names, counts, ids = read_file(value.as_buffer().to_pybytes()[:-1])
                edge = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge, edge[1:])]
                n = len(names)
                columns = [pa.array(names, pa.int64()), pa.array(counts), pa.array(crc, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(edge[:-1])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    schema = "doc_id long, n_tokens long, ids_crc32 long, part int, number int, place long" + ", ids array<long>" * with_ids
    fields = [c.split()[0] for c in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(tidy(rows), schema)


def token_digest(docs: DataFrame, vocabulary: str, file_ids: int = FILE_IDS, words: tuple[int, int] = (0, 0)) -> DataFrame:
    """Writes token files to the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts are the end id alone; repeated rows follow one another. start counts the ids
    of all documents before: those of earlier files (a sum over one row a file) and of the same file.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    small_batches(docs.sparkSession)
    write_tokens(docs, vocabulary, path, file_ids, words)
    found = materialise(read_tokens(docs.sparkSession, path), "token-index")
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("part", "number", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = found.join(files, ["part", "number"])
    return joined.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
