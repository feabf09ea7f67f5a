"""Shared plumbing of the training-data operators: word hashing, Arrow rows, joins of checked size."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narae.session import discard, materialise, release, scratch_path, small_batches, tidy  # noqa: F401

#: Words of most operators: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

def word_count(text: Column) -> Column:
    """Words of a text; null counts 0. JVM side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def table_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


# ---------------------------------------------------------------------------------------------
# Words of many texts at once, as 64-bit hashes, in numpy.

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_LONG = 1024


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


def join_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a blank after each, eight bytes of slack at the end; their starts."""
    texts = [t or b"" for t in texts]
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8), starts


def word_bounds(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the buffer; per text the index of its first word (n + 1 of them)."""
    white = _WHITE[buf]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time, for all words that are that long."""
    wide = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    size = end - begin
    out = mix((wide[begin] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), seed)
    todo, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(todo):
        left = np.minimum(size[todo] - at, 8)
        out[todo] = mix(out[todo] * np.uint64(0xFF51AFD7ED558CCD) + (wide[begin[todo] + at] & _KEEP[left]), seed)
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(buf[begin[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(4, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def window_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` consecutive word hashes (also across text borders)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for k in range(1, length):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out, seed + 17)


def windows_inside(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each window that lies within one text, and that text's index."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    skip = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - skip[text] + first[:-1][text], text


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------------------------------------
# Packed exchange: what a block of texts asks of a range of keys travels as one row.


def pack(*arrays: np.ndarray) -> bytes:
    """Plain arrays as one compressed value, each by the planes of its bytes."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    size = struct.unpack_from("<Q", data)[0]
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True)
    at, out = 1 + 10 * raw[0], []
    for k in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, 1 + 10 * k)
        form = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * form.itemsize, at)
        out.append(np.ascontiguousarray(planes.reshape(form.itemsize, n).T).view(form).ravel() if n else np.empty(0, form))
        at += len(planes)
    return out


def tight(values: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def squeeze(keys: np.ndarray) -> np.ndarray:
    """Sorted 64-bit keys as the byte planes of their differences."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()


def unsqueeze(planes: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    if n:
        steps[:, : len(planes) // n] = planes.reshape(-1, n).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def grouped(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of so many bits in order, a place of each, and which of them stands at each place."""
    # Leading bits and the place in one number sort faster than places by keys; the rest of the bits seldom matters.
    for_place = max(1, int(len(keys) - 1).bit_length()) if len(keys) else 1
    cut = max(0, bits + for_place - 64)
    both = (keys >> np.uint64(cut)) << np.uint64(for_place)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << for_place) - 1)
    order = both.astype(np.int32 if for_place < 32 else np.int64)
    ordered = keys[order]
    if len(keys) and (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(keys)
        ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    where = np.empty(len(keys), order.dtype)
    where[order] = np.cumsum(new, dtype=order.dtype) - 1
    return ordered[new], order[new], where


def range_bounds(parts: int, bits: int = 64) -> np.ndarray:
    """The least keys of all ranges but the first."""
    return np.array([-(-(k << bits) // parts) for k in range(1, parts)], dtype=np.uint64)


def range_cuts(keys: np.ndarray, parts: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(range, begin, end) of the ranges that sorted keys fall into."""
    at = [0, *np.searchsorted(keys, range_bounds(parts, bits)).tolist(), len(keys)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def merged(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of some ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def byte_slices(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all slices, one after another."""
    skip = np.cumsum(size) - size
    return buf[np.arange(int(size.sum())) + np.repeat(begin - skip, size)]


#: Bytes of text that numpy steps take at once (a longer text is taken alone).
PIECE = 4 << 20
#: Identifiers that are broadcast at most; beyond that they are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Stands for a null identifier: after all others.
NO_ID = 2**63 - 1


#: Bytes of input for each part of an exchange: a part is held by one task.
PART_BYTES = 16 << 20


def parts_for(docs: DataFrame) -> int:
    """Parts of an exchange over ``docs``: the session's number, or more where the input asks for it.

    The size is the plan's (of files: theirs); where the plan has none, texts are measured.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def row_key(name: str = "doc_id") -> Column:
    """An identifier as a long, null last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def pieces(texts: list[bytes], most: int = 0) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes (by default PIECE)."""
    most = most or PIECE
    out, start, held = [], 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > most:
            out.append((start, k))
            start, held = k, 0
        held += len(text)
    return [*out, (start, len(texts))] if len(texts) > start else out


def only_listed(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed: by a broadcast where the list is short, else by a shuffle."""
    if keys.count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    return rows.join(keys, key, "left_semi")


def runs_of(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the length of all at the end."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def raw_texts(column) -> list[bytes]:
    """The bytes of a binary Arrow column; null counts as empty."""
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column]
