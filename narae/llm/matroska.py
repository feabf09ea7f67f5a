"""Matroska media columns: a writer for 8-bit sample payloads and a parser that yields packet tables.

The parser reads variable-length EBML elements (identifiers and sizes of 1 to 8 bytes, unknown sizes
included), clusters, simple blocks and block groups with any lacing (none, Xiph, fixed, EBML) and
cues. Packets carry track, cluster, timestamp and byte range; payloads stay where they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narae.llm.shared import materialise, small_batches, tidy

# Element identifiers, as the format fixes them.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Payload unit: 576 samples of 8 bits, 10 ms at 57,600 Hz.
FRAME, RATE, FRAME_MS = 576, 57_600, 10
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 64


class Packet(NamedTuple):
    track: int
    cluster: int
    timestamp_ns: int
    offset: int
    length: int
    keyframe: bool
    lacing: int


class Cue(NamedTuple):
    track: int
    timestamp_ns: int
    cluster_offset: int


# --- writing ---------------------------------------------------------------------------------


def _identifier(name: int) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length integer; all ones in its value bits is kept for unknown sizes."""
    width = width or next(n for n in range(1, 9) if value < (1 << (7 * n)) - 1)
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def _element(name: int, body: bytes) -> bytes:
    return _identifier(name) + vint(len(body)) + body


def _number(name: int, value: int) -> bytes:
    return _element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The lace header and the frames of one block."""
    if lacing == NO_LACING:
        (frame,) = frames
        return frame
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == FIXED:
        if len(set(sizes)) > 1:
            raise ValueError("fixed lacing needs frames of one size")
    elif lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    else:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(n for n in range(1, 9) if abs(b - a) < (1 << (7 * n - 1)) - 1)
            head += vint(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def write_matroska(payload: bytes, lacing: int = FIXED, frame: int = FRAME) -> bytes:
    """One audio track of 8-bit samples, ``frame`` of them a packet, with cues to every cluster."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    head = _element(EBML, _element(DOC_TYPE, b"matroska") + _number(DOC_VERSION, 4) + _number(DOC_READ_VERSION, 2))
    info = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000))
    audio = _element(AUDIO, _element(SAMPLING, np.array(RATE, ">f4").tobytes()) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    entry = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT")
    body = [info, _element(TRACKS, _element(TRACK_ENTRY, entry + _number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + audio))]
    at, cues = sum(map(len, body)), []
    per_cluster = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for k in range(0, len(frames), per_cluster):
        blocks = [_number(CLUSTER_TIMESTAMP, k * FRAME_MS)]
        for j in range(k, min(k + per_cluster, len(frames)), FRAMES_PER_BLOCK):
            some = frames[j : min(j + FRAMES_PER_BLOCK, k + per_cluster)]
            kind = lacing if len(some) > 1 else NO_LACING
            flags = 0x80 | kind << 1
            blocks.append(_element(SIMPLE_BLOCK, vint(1) + ((j - k) * FRAME_MS).to_bytes(2, "big", signed=True) + bytes([flags]) + lace(some, kind)))
        position = _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at)
        cues.append(_element(CUE_POINT, _number(CUE_TIME, k * FRAME_MS) + _element(CUE_POSITIONS, position)))
        body.append(_element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    body.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(body))


# --- parsing ---------------------------------------------------------------------------------


def _read_vint(data: memoryview, at: int, marker: bool) -> tuple[int, int, bool]:
    """Value, width and whether all value bits are ones (an unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"no EBML length at byte {at}")
    width = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError("truncated EBML number")
    mask = (1 << (7 * width)) - 1
    return (value if marker else value & mask), width, value & mask == mask


def elements(data: memoryview, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, body start, body end) of the elements of a range.

    An element of unknown size ends before the next element that may not be its child.
    """
    at = start
    while at < end:
        name, width, _ = _read_vint(data, at, True)
        size, more, unknown = _read_vint(data, at + width, False)
        body = at + width + more
        stop = _unknown_end(data, name, body, end) if unknown else body + size
        if stop > end:
            raise ValueError(f"element {name:#x} at byte {at} goes beyond its parent")
        yield name, body, stop
        at = stop


def _unknown_end(data: memoryview, name: int, body: int, end: int) -> int:
    if name == SEGMENT:
        return end
    at = body
    while at < end:
        child, width, _ = _read_vint(data, at, True)
        if child in TOP_LEVEL:
            return at
        size, more, _ = _read_vint(data, at + width, False)
        at += width + more + size
    return end


def _uint(data: memoryview, body: int, stop: int) -> int:
    return int.from_bytes(data[body:stop], "big")


def _laced(data: memoryview, at: int, stop: int, lacing: int) -> list[tuple[int, int]]:
    if lacing == NO_LACING:
        return [(at, stop - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == EBML_LACING and count > 1:
        size, width, _ = _read_vint(data, at, False)
        sizes, at = [size], at + width
        for _ in range(count - 2):
            step, width, _ = _read_vint(data, at, False)
            sizes.append(sizes[-1] + step - (1 << (7 * width - 1)) + 1)
            at += width
    elif lacing == FIXED:
        sizes = [(stop - at) // count] * (count - 1)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0 or lacing == FIXED and len(set(sizes)) > 1:
        raise ValueError("lace sizes go beyond their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse_matroska(data: bytes) -> tuple[list[Packet], list[Cue]]:
    """Packet table and cue table of a Matroska file, in file order.

    Timestamps of laced frames advance by the track's default duration. Cue positions are turned
    into absolute byte offsets. Malformed input raises ValueError.
    """
    view = memoryview(data)
    packets: list[Packet] = []
    cues: list[Cue] = []
    try:
        for name, body, stop in elements(view, 0, len(view)):
            if name == SEGMENT:
                _segment(view, body, stop, packets, cues)
    except IndexError:
        raise ValueError("truncated Matroska data") from None
    return packets, cues


def _segment(view: memoryview, start: int, end: int, packets: list[Packet], cues: list[Cue]) -> None:
    scale, durations, cluster = 1_000_000, {}, -1
    for name, body, stop in elements(view, start, end):
        if name == INFO:
            scale = next((_uint(view, b, s) for n, b, s in elements(view, body, stop) if n == TIMESTAMP_SCALE), scale)
        elif name == TRACKS:
            for n, b, s in elements(view, body, stop):
                if n == TRACK_ENTRY:
                    entry = {x: (y, z) for x, y, z in elements(view, b, s)}
                    durations[_uint(view, *entry[TRACK_NUMBER])] = _uint(view, *entry[DEFAULT_DURATION]) if DEFAULT_DURATION in entry else 0
        elif name == CLUSTER:
            cluster += 1
            base = 0
            for n, b, s in elements(view, body, stop):
                if n == CLUSTER_TIMESTAMP:
                    base = _uint(view, b, s)
                elif n in (SIMPLE_BLOCK, BLOCK_GROUP):
                    parts = [(b, s)] if n == SIMPLE_BLOCK else [(y, z) for x, y, z in elements(view, b, s) if x == BLOCK]
                    for y, z in parts:
                        track, width, _ = _read_vint(view, y, False)
                        relative = int.from_bytes(view[y + width : y + width + 2], "big", signed=True)
                        flags = view[y + width + 2]
                        lacing = flags >> 1 & 3
                        first = (base + relative) * scale
                        for k, (at, size) in enumerate(_laced(view, y + width + 3, z, lacing)):
                            packets.append(Packet(track, cluster, first + k * durations.get(track, 0), at, size, bool(flags & 0x80) and n == SIMPLE_BLOCK, lacing))
        elif name == CUES:
            for n, b, s in elements(view, body, stop):
                point = list(elements(view, b, s)) if n == CUE_POINT else []
                time = next((_uint(view, y, z) for x, y, z in point if x == CUE_TIME), 0)
                for x, y, z in point:
                    if x == CUE_POSITIONS:
                        where = {i: _uint(view, j, k) for i, j, k in elements(view, y, z)}
                        cues.append(Cue(where.get(CUE_TRACK, 0), time * scale, start + where.get(CUE_CLUSTER, 0)))


# --- DataFrames ------------------------------------------------------------------------------

PACKETS = "key long, packet int, track int, cluster int, timestamp_ns long, byte_offset long, byte_length long, keyframe boolean, lacing int"
#: What is wrong with a media value, in a row without a packet.
PROBLEM = ", problem string"


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media", strict: bool = True) -> DataFrame:
    """One row a packet of every media value. A null value has no packets.

    Damaged media raises, or, unless ``strict``, gives one row that names the ``problem`` and no packet.
    """
    schema = PACKETS if strict else PACKETS + PROBLEM

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()][: len(names)]
        for batch in batches:
            out: list[tuple] = []
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if data.is_valid:
                    try:
                        packets, _ = parse_matroska(data.as_py())
                    except ValueError as error:
                        if strict:
                            raise
                        out.append((ident, *[None] * (len(names) - 2), str(error)))
                        continue
                    out += [(ident, k, *p, *[None] * (not strict)) for k, p in enumerate(packets)]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return media.select(F.col(key).cast("long"), F.col(column)).mapInArrow(tidy(rows), schema)


def pad(data: bytes, unit: int = FRAME) -> bytes:
    """Bytes 255 appended up to a positive multiple of ``unit``."""
    return data + b"\xff" * ((-len(data)) % unit if data else unit)


def media_column(docs: DataFrame, lacing: int = FIXED) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a Matroska file. A null text counts as empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column(1).cast(pa.large_binary())]
            media = pa.array((write_matroska(pad(t), lacing) for t in texts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(tidy(rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _feature(data: bytes, samples: np.ndarray, packets: list[Packet], cues: list[Cue]) -> str:
    """Packet structure and signal statistics, as one line."""
    wave = samples.astype(np.int32) - 128
    cued = sum(int.from_bytes(data[c.cluster_offset : c.cluster_offset + 4], "big") == CLUSTER for c in cues)
    power = float(np.mean(wave * wave))
    turns = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    last = packets[-1]
    return (
        f"tracks={len({p.track for p in packets})};packets={len(packets)};clusters={last.cluster + 1};cues={cued};"
        f"laced={sum(p.lacing > 0 for p in packets)};end_ms={last.timestamp_ns // 1_000_000 + FRAME_MS};"
        f"mean={float(np.mean(wave)):.6f};rms={power**0.5:.6f};peak={int(np.abs(wave).max())};crossings={turns}"
    )


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored media back: joins its packets' bytes to the payload and describes both."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(2):
                data = value.as_py()
                packets, cues = parse_matroska(data)
                payload = b"".join([data[p.offset : p.offset + p.length] for p in packets])
                out.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), _feature(data, np.frombuffer(payload, np.uint8), packets, cues))
                )
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f.split()[0] for f in MEDIA.split(", ")]])

    ident = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(rows), f"doc_id {ident}, {MEDIA}")


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text as media in a shared table, reads it back and returns one row a document.

    A null text counts as empty; an empty text is one packet of bytes 255. Repeated rows give
    repeated rows, equal texts equal values. Other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    return media_features(materialise(media_column(docs), "media"))
